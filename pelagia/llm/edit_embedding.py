"""Document fingerprints by randomised edit embedding (shared random walks over characters).

A walk reads a text by shared random bits: at step j on character c it writes c
and moves on only if bit (j, c) is set. Two texts at a small edit distance fall
back into step after an edit, so the written strings differ in few places. The
fingerprint samples the written string: the first ``SAMPLES`` steps, then
``SAMPLES`` fixed random steps of every octave [2**k, 2**(k+1)), one hex digit
each (``f`` once the walk has ended). All texts share the sampled steps, so
fingerprints of any two lengths compare; a step stands for its octave's share.

Walks of a batch run in lockstep in numpy. Whole texts are read, none is cut.

Cases: null counts as empty, whose fingerprint is the empty string; two empty
texts are alike (1.0), an empty and another one not (0.0). Equal texts have equal
fingerprints. With one document, its next is itself. Repeated doc_ids come in
the order of their texts; a null doc_id sorts first. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, freed

SAMPLES = 64
FIRST = SAMPLES.bit_length() - 1  # the octave that follows the first block
PERIOD = 1 << 13
END = 255
#: Code points that walk in one lockstep, about.
TOGETHER = 6_000_000
#: Members of a block, about, when the texts of one slice are compared.
BLOCK = 1024

_RNG = np.random.Generator(np.random.PCG64(52))
BITS = _RNG.integers(0, 2, (PERIOD, 256)).astype(np.int64)
BITS[:, END] = 0
CODE = np.concatenate([_RNG.integers(0, 15, 255), [15]]).astype(np.uint8)


def sampled(octave: int) -> np.ndarray:
    """Steps of an octave that fingerprints hold, ascending; block -1 is the steps before the first octave."""
    if octave < 0:
        return np.arange(SAMPLES)
    own = np.random.Generator(np.random.PCG64([3, octave]))
    size = 1 << octave
    return np.sort(size + own.choice(size, SAMPLES, replace=False) if size <= 1 << 16 else size + (np.arange(SAMPLES) * size + own.integers(0, size, SAMPLES)) // SAMPLES)


def classes(text: str) -> np.ndarray:
    """A class below 255 for every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((points * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) % np.uint64(251)).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sampled digits (0-15) of each text, one block of ``SAMPLES`` after another."""
    symbols = [classes(t) for t in texts]
    n = np.array([len(s) for s in symbols], np.int64)
    buf = np.concatenate([x for s in symbols for x in (s, np.array([END], np.uint8))]) if texts else np.zeros(0, np.uint8)
    ends = np.cumsum(n + 1) - 1
    live = np.argsort(-n, kind="stable")
    live = live[n[live] > 0]
    pos, stop = (ends - n)[live], ends[live]
    blocks: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their digits in this block
    j, octave = 0, -1
    while len(live):
        steps, size = sampled(octave), SAMPLES if octave < 0 else 1 << octave
        got, at = np.full((len(live), SAMPLES), 15, np.uint8), 0
        rows, index, until = live, np.arange(len(live)), j + size
        wanted = steps.tolist() + [-1]
        while j < until and len(index):
            pause = min(until, j + 256)
            while j < pause:
                c = buf[pos]
                if j == wanted[at]:
                    got[index, at] = CODE[c]
                    at += 1
                pos += BITS[j & PERIOD - 1][c]
                j += 1
            going = pos < stop
            if not going.all():
                pos, stop, index = pos[going], stop[going], index[going]
        blocks.append((rows, got))
        live = rows[index]
        octave = FIRST if octave < 0 else octave + 1
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, got in blocks:
        for r, digits in zip(rows.tolist(), got):
            out[r].append(digits)
    return [np.concatenate(d) if d else np.zeros(0, np.uint8) for d in out]


def weights(n: int) -> np.ndarray:
    """Steps that each of the first n sampled digits stands for."""
    blocks = -(-n // SAMPLES)
    return np.repeat([1.0, *(2.0 ** (FIRST + k) / SAMPLES for k in range(blocks - 1))][:blocks], SAMPLES)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted share of sampled steps at which both walks wrote the same, 0 to 1."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    a, b = (np.pad(x, (0, n - len(x)), constant_values=15) for x in (a, b))
    w = weights(n) * ((a != 15) | (b != 15))
    return float((w * (a == b)).sum() / w.sum())


def to_text(digits: np.ndarray) -> str:
    return (digits[0::2] << 4 | digits[1::2]).tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the next text's start."""
    m = len(text) // 2
    return text[: len(text) - m] + following[:m]


def in_order(docs: DataFrame, knots: int = 64) -> DataFrame:
    """Documents dealt into ordered buckets, each with the row that follows its last as a guest.

    Buckets come from a piecewise-linear map of doc_id through its quantiles, so
    they are even for any ids and the same whenever they are computed. Only
    quantiles and one id per bucket reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("_key"))
    buckets = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = sorted({int(x) for x in rows.approxQuantile("_key", [k / knots for k in range(knots + 1)], 0.002)})

    def place(lo: int, hi: int) -> Column:
        """Bucket of a key known to lie from knot lo on, below knot hi."""
        if hi - lo <= 1:
            share = (F.col("_key") - F.lit(q[lo])) / F.lit(float(max(1, q[hi] - q[lo]))) if hi < len(q) else F.lit(0.0)
            return F.floor(F.lit(float(buckets)) * (F.lit(float(lo)) + F.greatest(F.lit(0.0), F.least(F.lit(0.999999), share))) / F.lit(float(len(q))))
        mid = (lo + hi) // 2
        return F.when(F.col("_key") < q[mid], place(lo, mid)).otherwise(place(mid, hi))

    rows = rows.withColumn("_bucket", place(0, len(q)).cast("long") if q else F.lit(0).cast("long"))
    firsts = sorted((r["_bucket"], r["k"]) for r in rows.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())
    # the first row of each bucket is a guest of the one before; of the first bucket, of the last
    guests = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "_key long, _guest_of long")
    rows = rows.join(F.broadcast(guests), "_key", "left")  # one row per bucket
    places = F.array(F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("_guest_of").alias("at"), F.lit(True).alias("guest")))
    rows = rows.select("doc_id", "text", "_key", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p")).select("p.at", "p.guest", "_key", "doc_id", "text")
    return rows.repartition(buckets // 3, "at").sortWithinPartitions("at", "guest", "_key", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    bounded(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [p[1] for p in pairs]
        extra = [k for k, p in enumerate(pairs) if k + 1 == len(pairs) or pairs[k + 1][1] is not p[2]]
        changed = [edited(p[1], p[2]) for p in pairs]
        all_ = fingerprints(texts + changed + [pairs[k][2] for k in extra])
        n = len(pairs)
        following = {k: all_[2 * n + i] for i, k in enumerate(extra)}
        cols: list[list] = [[] for _ in names]
        for k, (doc, text, _) in enumerate(pairs):
            own, other = all_[k], all_[n + k]
            sha = hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest()
            for col, v in zip(cols, (doc, len(text), sha, to_text(own), to_text(other), likeness(own, other), likeness(own, following.get(k, all_[k + 1] if k + 1 < n else None)))):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        bucket, last, pairs, size = None, None, [], 0
        for b in batches:
            for at, guest, doc, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                text = text or ""
                if last is not None and at == bucket:
                    pairs.append((*last, text))
                    size += 2 * len(text)
                    if size > TOGETHER:
                        yield finish(pairs)
                        pairs, size = [], 0
                last, bucket = None if guest else (doc, text), at
        if pairs:
            yield finish(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(freed(run), schema)


def near_pairs(prints: DataFrame, texts: DataFrame, share: float = 0.1, bands: int = 8) -> DataFrame:
    """Bit-sampled banding and verification: (first, doc_id, edits) of near texts, first < doc_id.

    ``prints`` has doc_id and fingerprint, ``texts`` doc_id and text; a doc_id names
    one text. Equal texts are tied to their smallest doc_id, which stands for them
    all. Those whose fingerprints agree on a slice of any octave, a ``bands``th of
    it at every half slice, meet, every one with every other; a pair stays if its edit distance is at most
    ``share`` of the longer text. Slices of many members are compared in cells of
    two blocks of about ``BLOCK`` members. Empty texts meet nothing.
    """
    block = SAMPLES // 2 * 2
    width = SAMPLES // bands
    named = texts.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text").withColumn("_same", F.sha2(F.col("text"), 256))
    heads = named.groupBy("_same").agg(F.min("doc_id").alias("first"), F.min(F.length("text")).alias("_n"))
    copies = named.select("doc_id", "_same").distinct().join(heads, "_same").where("first <> doc_id").select("first", "doc_id", F.lit(0).alias("edits"))
    keyed = prints.where(F.length("fingerprint") > 0).join(heads.select(F.col("first").alias("doc_id"), "_n"), "doc_id").withColumn("_blocks", (F.length("fingerprint") / block).cast("int"))
    keys = F.expr(f"flatten(transform(sequence(0, _blocks - 1), b -> transform(sequence(0, {2 * bands - 2}), k -> concat_ws(':', b, k, substring(fingerprint, b * {block} + k * {width // 2} + 1, {width})))))")
    slices = keyed.select("doc_id", "_n", F.explode(keys).alias("slice")).where(f"NOT endswith(slice, '{'f' * width}')").distinct()
    blocks = slices.groupBy("slice").agg(F.count("*").alias("_m")).where("_m > 1").select("slice", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_of"))
    members = slices.join(blocks, "slice").withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_of")).cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    cells = members.select("slice", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "doc_id", "_n")
    left = cells.where("_own = _i").select("slice", "_i", "_j", F.col("doc_id").alias("_p"), F.col("_n").alias("_np"))
    right = cells.where("_own = _j").select("slice", "_i", "_j", F.col("doc_id").alias("_q"), F.col("_n").alias("_nq"))
    # of two lengths the difference is a lower bound of the edit distance
    met = left.join(right, ["slice", "_i", "_j"]).where("_i < _j OR _p < _q").where(F.abs(F.col("_np") - F.col("_nq")) <= (F.greatest("_np", "_nq") * share).cast("int"))
    met = met.select(F.least("_p", "_q").alias("first"), F.greatest("_p", "_q").alias("doc_id")).distinct()
    bodies = named.select("doc_id", "text").dropDuplicates(["doc_id"])
    pairs = met.join(bodies.select(F.col("doc_id").alias("first"), F.col("text").alias("_a")), "first").join(bodies.select("doc_id", F.col("text").alias("_b")), "doc_id")
    pairs = pairs.withColumn("_most", (F.greatest(F.length("_a"), F.length("_b")) * share).cast("int")).withColumn("edits", F.expr("levenshtein(_a, _b, _most)"))
    return pairs.where("edits >= 0").select("first", "doc_id", "edits").unionByName(copies)
