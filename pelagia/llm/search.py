"""Ranked lexical search over a two-level quantised index, exact to the last integer.

Documents are indexed where they are read, in segments: inverted lists of about a
million words, one row each. The first level of a list is a byte per posting, its
impact rounded upward, so that a byte bounds the exact impact from both sides; the
second level has the exact term frequency and length. A search reads the first
level of all segments for each document's bounds on its score, takes each item's
kth largest lower bound over all segments, and scores by integers every document
whose upper bound reaches it. No document that could rank is left out, ties included.

Postings are never dealt: df sums, the lower bounds and results, at most K an item and
task, are all that is shuffled. Items are searched in blocks of about BLOCK (item,
term) pairs, whose weights go to every task.

Cases: a null or empty text has no terms and isn't found; a null item text finds
nothing. Rows of one item_id are one item, with the terms of all its texts. A null
doc_id counts in N, L and df but can't be ranked (inside, -2^63 stands for it). Rows
that repeat a doc_id are ranked one by one. Long texts are cut into words piece by
piece. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_schema, bounded, freed, settle

K = 10
#: Words and documents of a segment, about; PIECE bytes of a text are split at a time.
WORDS, DOCS, PIECE = 1 << 20, 1 << 16, 4 << 20
#: (item, term) pairs searched together, about; bounds what every task gets.
BLOCK = 200_000
#: Impacts are below TOP; a byte counts in steps of TOP / 255.
TOP = 1_000_000
NO_ID = -(1 << 63)

#: Other bytes than 0-9, A-Z, a-z and those of non-ASCII characters become spaces; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
IS_TERM = np.frombuffer(FOLD, np.uint8) != 32

UPPER = np.arange(256, dtype=np.int64) * TOP // 255
LOWER = np.concatenate([[0], UPPER[:-1] + 1])

SEGMENT = "n_docs long, terms binary, starts binary, docs binary, impacts binary, tfs binary, doc_ids binary, lengths binary"
LEVEL_1 = ["terms", "starts", "docs", "impacts", "doc_ids"]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Exact impacts of terms that occur ``tf`` times in documents of ``n`` words, before weights."""
    m = 100 - 90 + 90 * n * docs // max(1, words)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def rounded(exact: np.ndarray) -> np.ndarray:
    """Impacts as bytes, rounded upward: LOWER[b] <= impact <= UPPER[b]."""
    return ((exact * 255 + TOP - 1) // TOP).astype(np.uint8)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row's begin and end; null counts as empty."""
    col = batch.column(name).cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), at


def sizes(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for b in batches:
            data, at = raw_texts(b)
            for i, j in zip(at[:-1], at[1:]):
                inside = IS_TERM[data[i:j]]
                k = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])
                n, words = n + (k > 0), words + k
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words]}, schema=arrow_schema("n long, words long"))

    got = docs.select("text").mapInArrow(freed(run), "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return got[0] or 0, got[1] or 0


class Segment:
    """Documents gathered for one row of the index."""

    def __init__(self, docs: int, words: int, piece: int = PIECE):
        self.docs, self.words, self.piece = docs, words, piece
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids, self.lengths, self.keys, self.tfs = [], [], [], []
        self.loose, self.owners, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        """A document; one without terms is left out."""
        text, at, n = text.translate(FOLD), 0, 0
        while at < len(text):
            end = text.find(b" ", at + self.piece)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            n, at = n + len(words), end
            self.loose += words
            self.owners.append((len(self.ids), len(words)))
            if len(self.loose) > self.piece // 8:
                self._count()
        if n:
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(n)
            self.size += n

    def _count(self) -> None:
        """Reduce words to (document, term) with their counts."""
        ids = np.fromiter(map(self.terms.__getitem__, self.loose), np.int64, len(self.loose))
        owner, n = np.array(self.owners, np.int64).reshape(-1, 2).T
        key, tf = np.unique(ids << 32 | np.repeat(owner, n), return_counts=True)
        self.keys.append(key)
        self.tfs.append(tf)
        self.loose, self.owners = [], []

    def row(self) -> dict[str, list]:
        self._count()
        key, where = np.unique(np.concatenate(self.keys), return_inverse=True)  # a long text is counted in pieces
        tf = np.bincount(where, np.concatenate(self.tfs), len(key)).astype(np.int64)
        doc, lengths = key & 0xFFFFFFFF, np.array(self.lengths, np.int64)
        starts = np.searchsorted(key >> 32, np.arange(len(self.terms) + 1)).astype(np.int32)
        level = rounded(impacts(tf, lengths[doc], self.docs, self.words))
        return {
            "n_docs": [len(lengths)], "terms": [b" ".join(self.terms)], "starts": [starts.tobytes()], "docs": [doc.astype(np.int32).tobytes()], "impacts": [level.tobytes()],
            "tfs": [tf.astype(np.int32).tobytes()], "doc_ids": [np.array(self.ids, np.int64).tobytes()], "lengths": [lengths.tobytes()],
        }


def build_index(docs: DataFrame, size: tuple[int, int] | None = None, most: int = WORDS, piece: int = PIECE) -> DataFrame:
    """The index of all documents, a row per segment of about ``most`` words. ``size``: N and L, if known."""
    bounded(docs.sparkSession)
    n, words = size or sizes(docs)
    schema = arrow_schema(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(n, words, piece)
        for b in batches:
            data, at = raw_texts(b)
            for doc_id, i, j in zip(b.column("doc_id").to_pylist(), at[:-1], at[1:]):
                segment.add(doc_id, data[i:j].tobytes())
                if segment.size >= most or len(segment.ids) >= DOCS:
                    yield pa.RecordBatch.from_pydict(segment.row(), schema=schema)
                    segment = Segment(n, words, piece)
        if segment.ids:
            yield pa.RecordBatch.from_pydict(segment.row(), schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), SEGMENT)


class Lists:
    """The inverted lists of a row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind) if name in batch.schema.names else None
        self.place = {t: k for k, t in enumerate(batch.column("terms")[row].as_py().split(b" "))}
        self.starts, self.docs, self.impacts = get("starts", np.int32), get("docs", np.int32), get("impacts", np.uint8)
        self.tfs, self.doc_ids, self.lengths = get("tfs", np.int32), get("doc_ids", np.int64), get("lengths", np.int64)

    def find(self, terms: dict[bytes, int]) -> list[tuple[slice, int]]:
        """Where the lists of these terms are, with their weights."""
        return [(slice(self.starts[k], self.starts[k + 1]), w) for t, w in terms.items() if (k := self.place.get(t)) is not None]

    def bound(self, found: list[tuple[slice, int]], table: np.ndarray) -> np.ndarray:
        """A bound of every document's score, from the bytes."""
        total = np.zeros(len(self.doc_ids), np.int64)
        for at, w in found:
            total[self.docs[at]] += (w * table)[self.impacts[at]]
        return total

    def exact(self, found: list[tuple[slice, int]], wanted: np.ndarray, size: tuple[int, int]) -> np.ndarray:
        """The scores of the wanted documents; 0 elsewhere."""
        total = np.zeros(len(self.doc_ids), np.int64)
        for at, w in found:
            doc, tf = self.docs[at], self.tfs[at].astype(np.int64)
            here = wanted[doc]
            doc, tf = doc[here], tf[here]
            total[doc] += w * impacts(tf, self.lengths[doc], *size)
        return total


def document_frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of these terms is."""
    ddl = "term binary, df long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for row in range(b.num_rows):
                starts = np.frombuffer(b.column("starts")[row].as_py(), np.int32)
                for k, t in enumerate(b.column("terms")[row].as_py().split(b" ")):
                    if t in terms:
                        sums[t] += int(starts[k + 1] - starts[k])
        yield pa.RecordBatch.from_pydict({"term": list(sums), "df": list(sums.values())}, schema=arrow_schema(ddl))

    rows = index.select("terms", "starts").mapInArrow(freed(run), ddl).groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in rows.collect()}  # at most as many as the block of items has


def weights(index: DataFrame, items: list[tuple[int | None, set[bytes]]], n: int) -> list[tuple[int | None, dict[bytes, int]]]:
    """Each item's terms with their weights; terms that no document has are left out."""
    df = document_frequencies(index, set().union(*(terms for _, terms in items)))
    ratios = {t: (2 * n + 2) / (2 * d + 1) for t, d in df.items()}
    spark = index.sparkSession
    values = sorted(set(ratios.values()))
    logs = spark.createDataFrame([(v,) for v in values], "ratio double").select("ratio", F.floor(1000 * F.log("ratio")).alias("w")).collect() if values else []
    w = {r["ratio"]: r["w"] for r in logs}
    return [(item, {t: w[ratios[t]] for t in sorted(terms) if t in ratios}) for item, terms in items]


def best(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of each item in this order, with rank; tasks' rows meet in two steps."""
    some = rows.withColumn("_task", F.spark_partition_id() % 64)
    step = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_task").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return step.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("_task")


def each_segment(index: DataFrame, names: list[str], ddl: str, items: int, score: Callable[[Lists, int], tuple[np.ndarray, ...]], keep: Callable[..., np.ndarray]) -> DataFrame:
    """Rows (item, ...) that ``keep`` leaves of what ``score`` gives of each item, over all segments of a task."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for b in batches:
            for row in range(b.num_rows):
                lists = Lists(b, row)
                for i in range(items):
                    found = score(lists, i)
                    if len(found[0]):
                        both = tuple(np.concatenate(x) for x in zip(held[i], found)) if i in held else found
                        at = keep(*both)
                        held[i] = tuple(x[at] for x in both)
        item = np.repeat(np.array(list(held), np.int64), [len(v[0]) for v in held.values()])
        columns = [np.concatenate(x) for x in zip(*held.values())] if held else [np.zeros(0, np.int64)] * (len(schema) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([item, *columns], schema)], schema=schema)

    return index.select(*names).mapInArrow(freed(run), ddl)


def search_block(index: DataFrame, items: list[tuple[int | None, set[bytes]]], size: tuple[int, int], k: int) -> DataFrame:
    """The k best documents of each of these items."""
    spark = index.sparkSession
    asked = [terms for _, terms in weights(index, items, size[0])]

    def lowest(lists: Lists, i: int) -> tuple[np.ndarray, ...]:
        if not (found := lists.find(asked[i])):
            return (np.zeros(0, np.int64),)
        low = lists.bound(found, LOWER)[lists.doc_ids != NO_ID]
        return (low[low > 0],)

    most = lambda low: np.argpartition(low, -k)[-k:] if len(low) > k else slice(None)
    lower = each_segment(index, LEVEL_1, "item long, low long", len(items), lowest, most)
    reach = {r["item"]: r["low"] for r in best(lower, [F.desc("low")], k).where(F.col("rank") == k).collect()}  # one number an item

    def exact(lists: Lists, i: int) -> tuple[np.ndarray, ...]:
        nothing = (np.zeros(0, np.int64),) * 2
        if not (found := lists.find(asked[i])):
            return nothing
        wanted = (lists.bound(found, UPPER) >= max(1, reach.get(i, 1))) & (lists.doc_ids != NO_ID)
        if not wanted.any():
            return nothing
        total = lists.exact(found, wanted, size)
        at = np.flatnonzero(total > 0)
        return total[at], lists.doc_ids[at]

    first = lambda total, doc_id: np.lexsort((doc_id, -total))[:k]
    rows = each_segment(index, [*LEVEL_1, "tfs", "lengths"], "item long, score long, doc_id long", len(items), exact, first)
    ranked = best(rows, [F.desc("score"), F.asc("doc_id")], k)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) pairs of all items."""
    ddl = "item_id long, term binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = raw_texts(b)
            for item, i, j in zip(b.column("item_id").to_pylist(), at[:-1], at[1:]):
                terms = list(set(data[i:j].tobytes().translate(FOLD).split()))
                yield pa.RecordBatch.from_pydict({"item_id": [item] * len(terms), "term": terms}, schema=arrow_schema(ddl))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(freed(run), ddl).distinct()


def search(index: DataFrame, items: DataFrame, size: tuple[int, int], k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item.

    ``index`` is what ``build_index`` gave, saved or settled; ``size`` is N and L.
    """
    bounded(index.sparkSession)
    pairs = settle(item_terms(items))
    parts = -(-pairs.count() // block)
    dealt = pairs.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, parts))))
    out = index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(parts):
        terms: dict[int | None, set[bytes]] = defaultdict(set)
        for r in dealt.where(F.col("_block") == b).collect():  # about ``block`` pairs
            terms[r["item_id"]].add(bytes(r["term"]))
        if terms:
            out = out.unionByName(search_block(index, list(terms.items()), size, k))
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every item: indexes all documents, once, and searches."""
    bounded(docs.sparkSession)
    size = sizes(docs)
    return search(settle(build_index(docs, size)), items, size, k)
