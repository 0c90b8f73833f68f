"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features of a text are its lower-cased words and word pairs, hashed into
``2 ** BITS`` places and averaged over the text, plus hashed shapes of the words
(runs of letters, digits and other signs), which carry over to unseen words.
Training passes a bounded, deterministic sample of labelled texts through
follow-the-regularised-leader updates in one executor task; the weights (one
double per place) are then broadcast, and a score is a sparse dot product.

Cases: null and empty texts score by the bias alone; texts are read whole. With
no labelled rows every score is 0.5. Repeated rows score alike; labels repeated
for a doc_id count once each. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, filter_rows, freed, fold_hash, held_out, map_rows, mix64
from pelagia.llm.words import LOWER, BLANK, chunked, powers, BASE, UNBASE, BYTE

BITS = 18
#: Most labelled texts, about, that training reads.
SAMPLE = 6000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 1e-6, 1e-6, 4
THRESHOLD = 0.7
#: A text's features sum to this much, whatever its length.
SCALE = 30.0

#: Byte classes for word shapes: lower letters, capitals, digits, other signs by themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 1, 2, 3, 1


def _hashed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix64((total[last] - total[first]) * powers(UNBASE, len(values))[first])


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts end to end, and their number by text."""
    places, counts = [], []
    for a, b in chunked(texts):
        raw = np.frombuffer(b" ".join([*texts[a:b], b""]), np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[raw]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = _hashed(BYTE[LOWER[raw]], first, last)
        shape = SHAPE[raw]
        fresh = np.concatenate([[True], shape[1:] != shape[:-1]])  # runs of one class count once
        shapes = _hashed_runs(shape, fresh, first, last)
        n = np.diff(np.concatenate([[0], np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts[a:b]]))]))
        pair = mix64(words + np.roll(words, -1) * np.uint64(3) + np.uint64(7))
        rows = np.stack([words, pair, shapes + np.uint64(11)], 1) >> np.uint64(64 - bits)
        end = np.cumsum(n)[n > 0] - 1
        rows[end, 1] = rows[end, 0]  # a text's last word has no pair: it counts twice
        places.append(rows.reshape(-1).astype(np.int64))
        counts.append(3 * n)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(counts)


def _hashed_runs(shape: np.ndarray, fresh: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    fresh = fresh.copy()
    fresh[first] = True
    kept = np.flatnonzero(fresh)
    return _hashed(BYTE[shape[kept]], np.searchsorted(kept, first), np.searchsorted(kept, last))


def sums(weights: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features."""
    out, some = np.zeros(len(counts)), np.flatnonzero(counts)
    if len(some):  # each text by itself, so that its neighbours in a batch don't matter
        out[some] = np.add.reduceat(weights[places], (np.cumsum(counts) - counts)[some]) / counts[some]
    return out


def train(texts: list[bytes], labels: np.ndarray, bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal over the texts in the given order; the last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    places, counts = features(texts, bits)
    ends = np.cumsum(counts)
    rows = []
    for a, b in zip(ends - counts, ends):
        where, times = np.unique(places[a:b], return_counts=True)
        rows.append((np.append(where, size - 1), np.append(times * (SCALE / max(1, b - a)), 1.0)))

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(passes):
        for (at, x), y in zip(rows, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights from labelled documents outside the held-out fold.

    The sample has about ``sample`` documents, taken by a hash of the id, and is
    trained on, in the order of that hash, in one task.
    """
    bounded(docs.sparkSession)
    known = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    rows = docs.select("doc_id", "text").join(known.where(fold_hash(F.col("doc_id"), 10) < share), "doc_id")
    rows = rows.select("text", "quality", fold_hash(F.col("doc_id"), 10).alias("order"), "doc_id").repartition(1).sortWithinPartitions("order", "doc_id", "text", "quality")

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += [(t or "").encode() for t in b.column(0).to_pylist()]
            y += b.column(1).to_pylist()
        w = train(texts, np.array(y, float), bits) if texts else np.zeros((1 << bits) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])

    got = rows.mapInArrow(freed(run), "weights binary").collect()  # one array of 2 ** bits + 1 doubles
    return np.frombuffer(got[0][0]) if got else np.zeros((1 << bits) + 1)


class Scorer:
    """Scores texts by the weights."""

    def __init__(self, weights: np.ndarray):
        self.w, self.bits = weights, (len(weights) - 1).bit_length() - 1

    def score(self, texts: list[str | None]) -> np.ndarray:
        places, counts = features([(t or "").encode() for t in texts], self.bits)
        return 1 / (1 + np.exp(-np.clip(SCALE * sums(self.w[:-1], places, counts) + self.w[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    spark = bounded(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)  # 2 ** BITS + 1 doubles, whatever the data

    def make():
        scorer = Scorer(shared.value)

        def step(batch):
            p = scorer.score(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

        return step

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold; all columns stay, nothing is shuffled.

    With no labelled rows there is nothing to judge by, and all rows stay.
    """
    weights = fit(docs, labels)
    if not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        scorer = Scorer(shared.value)
        return lambda batch: scorer.score(batch.column("text").to_pylist()) >= threshold

    return filter_rows(docs, make)
