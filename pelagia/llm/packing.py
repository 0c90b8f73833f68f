"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

Lengths are small integers, so the packer works on counts: a segment tree over
remaining capacities says in logarithmic time which open bins are the tightest
that fit, and whole runs of equal pieces go into runs of equal bins at once.
The result is the one that best-fit decreasing gives piece by piece; its size
depends on the capacity only, never on the number of documents. The driver sees
one count per (length, bucket); the executors number the pieces of each length
within hash buckets, so that a length that a third of all pieces have is still
spread, and look their run up in the plan.

Cases: a null text is an empty document and has one piece, the end token. Only
documents above the capacity are cut. Repeated doc_ids are packed each on its
own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.bpe import loaded
from pelagia.llm.common import bounded, freed, settle, texts_of

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one numbering bucket holds, about; the root of their number if that is more.
PER_BUCKET = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have an open bin."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        node = capacity + self.leaves
        self.open[node] = value
        while node > 1:
            node //= 2
            now = self.open[2 * node] | self.open[2 * node + 1]
            if self.open[node] == now:
                return
            self.open[node] = now

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` with an open bin."""
        node = need + self.leaves
        if self.open[node]:
            return need
        while node > 1:  # up to the first right sibling with an open bin, then down its left edge
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts by length.

    Returns runs (length, first rank, first bin, pieces per bin, offset in the bin)
    and the number of bins. The pieces of a run with ranks first, first + 1, ...
    fill its bins in order, ``pieces per bin`` each.
    """
    tree, groups = CapacityTree(capacity), {}  # remaining capacity: runs (first bin, bins)
    runs, bins = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0

        def place(first: int, n: int, remaining: int) -> int:
            """Put pieces into up to n bins of a run; returns how many bins stay untouched."""
            nonlocal left, rank
            each = remaining // length
            full = min(n, left // each)
            after = []
            if full:
                runs.append((length, rank, first, each, capacity - remaining))
                rank, left = rank + full * each, left - full * each
                after.append((first, full, remaining - each * length))
            if left and full < n:  # the last bin takes what is left, fewer than ``each``
                runs.append((length, rank, first + full, each, capacity - remaining))
                after.append((first + full, 1, remaining - left * length))
                rank, left, full = rank + left, 0, full + 1
            for a, k, rest in after:
                groups.setdefault(rest, []).append((a, k))
                tree.set(rest, rest > 0)
            return n - full

        while left:
            tight = tree.tightest(length)
            if tight is None:
                new = -(-left // (capacity // length))
                first, bins = bins, bins + new
                place(first, new, capacity)
            else:
                first, n = groups[tight].pop()
                if not groups[tight]:
                    tree.set(tight, False)
                if rest := place(first, n, tight):
                    groups[tight].append((first + n - rest, rest))
                    tree.set(tight, True)
    return runs, bins


def cut_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts and cut those above the capacity: one row per piece."""
    bounded(df.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, packed in zip(b.column("doc_id").to_pylist(), bpe.encode_packed(texts_of(b))):
                packed += end
                n = len(packed) // 4
                for k in range(0, n, capacity):
                    part = packed[4 * k : 4 * (k + capacity)]
                    for col, v in zip(rows, (doc, k // capacity, k, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        bpe.afresh()

    return df.select("doc_id", "text").mapInArrow(freed(run), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, piece, length, ...).

    ``pieces`` must give the same rows each time it is read (see ``settle``).
    """
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    runs, _ = plan(by_length, capacity)
    # a length that many pieces have is numbered in as many buckets as it needs; at most one row per length
    needs = spark.createDataFrame([(n, max(1, math.ceil(c / max(per_bucket, math.isqrt(c))))) for n, c in by_length.items()], "length long, _buckets long")
    bucketed = pieces.join(F.broadcast(needs), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_buckets"))).drop("_buckets")
    # first rank of every (length, bucket): counts only, numbered per length
    firsts = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).select("length", "_bucket", "_first")
    ranked = bucketed.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(firsts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_row")).drop("_bucket", "_first", "_row")
    table = np.array(runs, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    shared = spark.sparkContext.broadcast(table[order])  # bounded by the capacity, not by the data

    def place(batches):
        t = shared.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            run = t[np.searchsorted(key, length << 44 | rank, "right") - 1]
            at = rank - run[:, 1]
            keep = [b.column(k) for k, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(run[:, 2] + at // run[:, 3]), pa.array(run[:, 4] + at % run[:, 3] * length)], [n for n in b.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(freed(place), f"{rest}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Tokens are made once; the piece table (a few dozen bytes per document) is
    checkpointed because both the counts and the numbering read it.
    """
    out = pack(settle(cut_pieces(df, path, capacity, end_id)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
