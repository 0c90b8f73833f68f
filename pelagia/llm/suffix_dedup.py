"""Suffix-array dedup: bytes of strings that an earlier document has too are removed.

Every string of ``LENGTH`` bytes has an anchor, the position of the smallest hash
of ``GRAM`` bytes in it; equal strings have equal anchors. So suffixes need
sorting only among those with the same anchor gram, and only where the gram
stands in several documents. The plan:

1. whole texts are dealt into blocks of ``BLOCK`` bytes or more by a hash, in one
   exchange that steps 2, 3 and 5 read;
2. a block sends each gram number of its anchors once, sorted, to the gram's
   bucket; the bucket answers every block with a bit per gram, in the same
   order: whether another block has it, and whether many have;
3. the block finds its anchors again and sorts the stretches of bytes that the
   strings of shared anchors cover, deep-shallow; of equal stretches all but the
   smallest doc_id's are settled there, and each kind is sent once with its
   bytes and the places where it stands. The strings of a gram that many blocks
   have go one by one, dealt by a hash of their bytes, so that no bucket gets
   all the surroundings of a common phrase;
4. per bucket, deep-shallow sorting orders the kinds, and the strings of
   differing kinds of a gram, by their bytes; equal ones learn their smallest
   doc_id;
5. covered stretches return to their block, which cuts them out of its texts.

Hashes only bring candidates together: what is removed is decided on bytes.
Arrays travel as byte planes under zstd, so the shuffles besides the texts' own
stay near a few bytes an anchor.

Cases: a null text is empty. Texts shorter than ``LENGTH`` bytes keep everything.
Of equal texts the smallest doc_id keeps its bytes; rows with the same doc_id
are no earlier than each other. A null doc_id neither loses bytes nor lets others
lose any. An empty table gives no rows; extra columns may have any names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, fresh_names, mix64, release
from pelagia.llm.suffix_sort import deep_shallow, words_at

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of text of a block, about, and positions whose hashes are held at once.
BLOCK, SLICE = 2 << 20, 1 << 18
PLACE_BITS = 20
#: Bits of a gram number besides those that count the anchors: how seldom two grams share a number.
SPARE_BITS = 18
#: Buckets at least; more if the session has more shuffle partitions or the texts more bytes.
BUCKETS = 256
#: Bytes of text to one bucket of gram numbers and of stretches, about: a reducer holds one bucket.
GRAM_BUCKET, STRETCH_BUCKET = 16 << 20, 2 << 20
#: Bytes of text in all up to which blocks and buckets have these sizes. Beyond, both grow with the root of all
#: bytes, so that the records from blocks to buckets grow as the text, not as its square; so many times at most.
EVEN, MOST = 1 << 30, 8.0
#: Bytes that are sorted before the tries: strings that were brought together share a gram's bytes anyway.
SHALLOW = 48
#: Blocks from which on a gram's strings are dealt one by one: below, all its stretches fit into a reducer.
MANY = 4096


def gram_hashes(word: np.ndarray, low: int, high: int) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position in [low, high) on."""
    w = word[low : high + GRAM - 8].astype(np.uint64)
    n = high - low
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h = mix64(h)
        h += w[k : k + n] * np.uint64(0x632BE59BD9B4E019)
    return mix64(h)


def string_hashes(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hash of the LENGTH bytes from each start on."""
    h = np.zeros(len(start), np.uint64)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = mix64(h + word[start + k].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(1))
    return h


def bits_for(n: int) -> int:
    return max(0, n - 1).bit_length()


class Numbers:
    """How hashes become gram numbers and buckets, for texts of ``size`` bytes in all."""

    def __init__(self, partitions: int, size: int):
        self.total = min(64, bits_for(size // 8 + 2) + SPARE_BITS)
        wide = min(MOST, max(1.0, size / EVEN) ** 0.5)
        self.gram_bucket = min(self.total, bits_for(max(BUCKETS, partitions, int(size / (GRAM_BUCKET * wide)))))
        self.stretch_bucket = min(self.total, bits_for(max(BUCKETS, partitions, int(size / (STRETCH_BUCKET * wide)))))
        self.blocks = max(partitions, int(-(-size // (BLOCK * wide))))
        self.many = MANY

    def of(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes; mixed anew, for the hashes of anchors are small, being the smallest of their strings."""
        return mix64(h + np.uint64(1)) >> np.uint64(64 - self.total)

    def bucket(self, g: np.ndarray, bits: int) -> np.ndarray:
        return (g >> np.uint64(self.total - bits)).astype(np.int64)


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor runs of texts laid end to end: (text number, anchor, first start, last start, gram hash).

    A run is the consecutive string starts that have the same anchor. Hashes are
    made for ``SLICE`` positions at a time.
    """
    n = len(buf) - LENGTH + 1
    found = []
    word = words_at(buf)
    for low in range(0, max(n, 0), SLICE):
        high = min(n, low + SLICE)
        h = gram_hashes(word, low, high + WINDOW - 1)
        key = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        size, best = 1, key
        while 2 * size <= WINDOW:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < WINDOW:
            best = np.minimum(best[: len(best) - (WINDOW - size)], best[WINDOW - size :])
        anchor = (best[: high - low] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        start = np.arange(low, high)
        among = np.arange(*np.searchsorted(ends, [low, high - 1], "right") + [0, 1])
        text = np.repeat(among, np.diff(np.minimum(ends[among], high), prepend=low))
        inside = start + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        fresh = np.ones(high - low, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(fresh & inside)
        # a run ends before the next fresh or outside start
        last = np.flatnonzero(np.append((fresh | ~inside)[1:], True) & inside)
        found.append((text[first], anchor[first] + low, first + low, last + low, h[anchor[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    text, a, first, last, h = (np.concatenate(x) for x in zip(*found))
    # a run that a slice's end cut in two is one run
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)
    return text[head], a[head], first[head], last[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)] if len(a) else last, h[head]


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte of their value, which compresses well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


@cache
def coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray, raw: bytes = b"") -> bytes:
    """Whole numbers below 2 ** 63 in arrays, and bytes, as one compressed blob."""
    head, parts = [len(arrays)], []
    for x in arrays:
        width = 8 if len(x) and int(x.min()) < 0 else max(1, (int(x.max()).bit_length() + 7) // 8 if len(x) else 1)
        head += [len(x), width]
        parts.append(planes(x, width))
    return coder()[0].compress(b"".join([np.array(head, "<u4").tobytes(), *parts, raw]))


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    body = coder()[1].decompress(blob)
    count = int(np.frombuffer(body, "<u4", 1)[0])
    head = np.frombuffer(body, "<u4", 2 * count, 4).tolist()
    at, out = 4 + 8 * count, []
    for n, width in zip(head[::2], head[1::2]):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view("<i8").reshape(-1))
        at += n * width
    return out, body[at:]


def runs_of(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return starts, np.append(starts[1:], len(sorted_))


def spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, low[k], low[k] + 1, ... ``count[k]`` numbers; and which k each comes from."""
    owner = np.repeat(np.arange(len(count)), count)
    return low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


class Block:
    """The texts of a block end to end, those with a doc_id; rows of one doc_id and key share a rank."""

    def __init__(self, table: pa.Table, names: tuple[str, str, str]):
        doc, key, text = (table.column(c).to_pylist() for c in names)
        rows = [k for k, d in enumerate(doc) if d is not None]
        self.texts = [(text[k] or "").encode("utf-8", "surrogatepass") for k in rows]
        self.ids, keys = np.array([doc[k] for k in rows], np.int64), np.array([key[k] for k in rows], np.int64)
        order = np.lexsort((keys, self.ids))
        i, k = self.ids[order], keys[order]
        self.rank = np.empty(len(rows), np.int64)
        self.rank[order] = np.cumsum(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])[: len(rows)]) - 1
        self.rows = rows

    def laid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes end to end, where each text ends, and where each starts."""
        n = np.array([len(t) for t in self.texts], np.int64)
        ends = np.cumsum(n)
        return np.frombuffer(b"".join(self.texts), np.uint8), ends, ends - n


GRAMS = "bucket long, block long, blob binary"
BACK = "block long, bucket long, blob binary"
COVERED = "block long, blob binary"


def table_of(ddl: str, rows: list[tuple]) -> pa.Table:
    """Rows of longs, with a blob last."""
    names = [c.split()[0] for c in ddl.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, pa.binary() if n == "blob" else pa.int64()) for n, c in zip(names, cols)], names=names)


def gram_records(numbers: Numbers, names: tuple, place: str):
    """Step 2, of a block: its gram numbers by bucket, each once, as differences."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, names)
        buf, ends, _ = block.laid()
        g = np.unique(numbers.of(anchors(buf, ends)[4]))
        bucket = numbers.bucket(g, numbers.gram_bucket)
        at = table.column(place)[0].as_py()
        out = []
        for a, z in zip(*runs_of(bucket)):
            low = np.uint64(int(bucket[a]) << numbers.total - numbers.gram_bucket)
            out.append((int(bucket[a]), at, pack(np.diff(g[a:z] - low, prepend=np.uint64(0)).astype(np.int64))))
        release()
        return table_of(GRAMS, out)

    return run


def by_bucket(batches, settle_bucket):
    """Call ``settle_bucket`` with the (block, blob) pairs of each bucket of rows sorted by bucket."""
    at, held = None, []
    for b in batches:
        for bucket, block, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
            if bucket != at and held:
                yield from settle_bucket(at, held)
                held = []
            at = bucket
            held.append((block, blob))
    if held:
        yield from settle_bucket(at, held)
    release()


def shared_grams(numbers: Numbers):
    """Step 2, of a bucket: for each block a bit per gram, another block has it, and many have."""

    def settle_bucket(bucket, held):
        grams = [np.cumsum(unpack(blob)[0][0]) for _, blob in held]
        size = np.array([len(g) for g in grams])
        _, kind, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        count = np.split(count[kind], np.cumsum(size)[:-1])
        out = [(block, bucket, pack(raw=np.packbits(np.concatenate([n > 1, n >= numbers.many])).tobytes())) for (block, _), n in zip(held, count) if n.max() > 1]
        if out:
            yield from table_of(BACK, out).to_batches()

    return lambda batches: by_bucket(batches, settle_bucket)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the stretches [first, last) cover."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    gap = np.flatnonzero(first[1:] > reach[:-1]) + 1
    return first[np.append(0, gap)], reach[np.append(gap - 1, len(reach) - 1)]


def stretch_records(numbers: Numbers, names: tuple, place: str):
    """Step 3, of a block and the answers to it: kinds of stretches by bucket, and what is settled (bucket below 0)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, names)
        buf, ends, begins = block.laid()
        text, a, first, last, h = anchors(buf, ends)
        grams, kind = np.unique(numbers.of(h), return_inverse=True)
        several, many = np.zeros(len(grams), bool), np.zeros(len(grams), bool)
        bucket = numbers.bucket(grams, numbers.gram_bucket)
        for at, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
            lo, hi = np.searchsorted(bucket, at), np.searchsorted(bucket, at, "right")
            bits = np.unpackbits(np.frombuffer(unpack(blob)[1], np.uint8))[: 2 * (hi - lo)].astype(bool)
            several[lo:hi], many[lo:hi] = bits[: hi - lo], bits[hi - lo :]
        ids = block.ids[text]
        least, most = np.full(len(grams), np.iinfo(np.int64).max), np.full(len(grams), np.iinfo(np.int64).min)
        np.minimum.at(least, kind, ids)
        np.maximum.at(most, kind, ids)
        several |= least < most
        mine = several[kind]
        text, a, first, last, g, one = text[mine], a[mine], first[mine], last[mine], grams[kind[mine]], many[kind[mine]]
        if not len(text):
            return table_of(GRAMS, [])
        word = words_at(buf)
        # strings of a common gram go one by one, under a number of their own
        single, owner = spread(first[one], (last - first + 1)[one])
        text, a = (np.concatenate([x[~one], x[one][owner]]) for x in (text, a))
        start = np.concatenate([first[~one], single])
        size = np.concatenate([(last - first + LENGTH)[~one], np.full(len(single), LENGTH, np.int64)])
        g = np.concatenate([g[~one], numbers.of(string_hashes(word, single))])
        order, equal = deep_shallow(buf, start, size, word, first=mix_keys(g, a - start), shallow=SHALLOW)
        doc, kind = block.ids[text], np.empty(len(order), np.int64)
        kind[order] = np.cumsum(~equal) - 1
        heads = order[~equal]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(~equal))
        later = doc > least[kind]
        at, out = table.column(place)[0].as_py(), []
        if later.any():
            # a place between any two texts keeps their stretches apart
            lo, hi = merged(start[later] + text[later], start[later] + size[later] + text[later])
            t = np.searchsorted(begins + np.arange(len(begins)), lo, "right") - 1
            out.append((-1 - at, at, pack(block.rank[t], lo - t - begins[t], hi - t - begins[t])))
        by_kind = np.flatnonzero(~later)
        by_kind = by_kind[np.argsort(kind[by_kind], kind="stable")]
        lo, hi = runs_of(kind[by_kind])
        bucket = numbers.bucket(g[heads], numbers.stretch_bucket)
        to = np.argsort(bucket, kind="stable")
        raw = buf.tobytes()
        for x, z in zip(*runs_of(bucket[to])):
            k = to[x:z]
            s, n = start[heads[k]], size[heads[k]]
            where, _ = spread(lo[k], (hi - lo)[k])
            who = by_kind[where]
            strings = b"".join(raw[i : i + m] for i, m in zip(s.tolist(), n.tolist()))
            low = int(bucket[k[0]]) << numbers.total - numbers.stretch_bucket
            out.append((int(bucket[k[0]]), at, pack((g[heads[k]] - np.uint64(low)).astype(np.int64), a[heads[k]] - s, n, least[k], (hi - lo)[k], block.rank[text[who]], start[who] - begins[text[who]], raw=strings)))
        release()
        return table_of(GRAMS, out)

    return run


def mix_keys(g: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """One number for a gram and its offset in the string or stretch."""
    return mix64(g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64))


def covered_stretches(batches):
    """Step 4, of a bucket: from kinds of stretches, what earlier documents cover, by block."""

    def settle_bucket(bucket, held):
        if bucket < 0:  # settled in the block
            yield from table_of(COVERED, held).to_batches()
            return
        parts = [unpack(blob) for _, blob in held]
        gram, anchor, size, least, times = (np.concatenate([p[0][k] for p in parts]) for k in range(5))
        rank, begin = (np.concatenate([p[0][k] for p in parts]) for k in (5, 6))
        home = np.repeat(np.arange(len(held)), [len(p[0][5]) for p in parts])  # of each place, its record
        buf = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        del parts
        start, places = np.cumsum(size) - size, np.cumsum(times) - times
        word = words_at(buf)
        order, equal = deep_shallow(buf, start, size, word, first=mix_keys(gram, anchor), shallow=SHALLOW)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~equal) - 1
        heads = order[~equal]  # one stretch of each kind
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(~equal))
        later = least > lowest[group]
        found = []  # (place, from, to) of covered parts
        where, owner = spread(places[later], times[later])
        found.append((where, np.zeros(len(where), np.int64), size[later][owner]))
        # kinds whose gram has other kinds too: their single strings may agree
        by_gram = np.argsort(gram[heads], kind="stable")
        lo, hi = runs_of(gram[heads][by_gram])
        mixed = by_gram[np.repeat(hi - lo > 1, hi - lo)]
        if len(mixed):
            step, owner = spread(np.zeros(len(mixed), np.int64), size[heads[mixed]] - LENGTH + 1)
            kind = mixed[owner]
            string = start[heads[kind]] + step
            order, equal = deep_shallow(buf, string, np.full(len(string), LENGTH), word, first=mix_keys(gram[heads[kind]], anchor[heads[kind]] - step), shallow=SHALLOW)
            low = np.minimum.reduceat(lowest[kind[order]], np.flatnonzero(~equal))
            hit = np.zeros(len(kind), bool)
            hit[order] = lowest[kind[order]] > low[np.cumsum(~equal) - 1]
            fresh = hit & np.concatenate([[True], ~hit[:-1] | (kind[1:] != kind[:-1])])
            stop = hit & np.concatenate([~hit[1:] | (kind[1:] != kind[:-1]), [True]])
            k, x, z = kind[fresh], step[fresh], step[stop] + LENGTH
            # back to every stretch of the kind that the kind's own smallest document has
            own = np.flatnonzero(~later)
            own = own[np.argsort(group[own], kind="stable")]
            left, right = np.searchsorted(group[own], k), np.searchsorted(group[own], k, "right")
            at, span = spread(left, right - left)
            where, which = spread(places[own[at]], times[own[at]])
            found.append((where, x[span][which], z[span][which]))
        where, x, z = (np.concatenate(c) for c in zip(*found))
        if len(where):
            by_home = np.argsort(home[where], kind="stable")
            where, x, z = where[by_home], x[by_home], z[by_home]
            out = [(held[home[where[i]]][0], pack(rank[where[i:j]], begin[where[i:j]] + x[i:j], begin[where[i:j]] + z[i:j])) for i, j in zip(*runs_of(home[where]))]
            yield from table_of(COVERED, out).to_batches()

    return by_bucket(batches, settle_bucket)


def cut_out(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[bytes, int]:
    """What is left of a text without the covered stretches, and the number of removed runs."""
    if spans is None:
        return text, 0
    at, parts, count = 0, [], 0
    for a, b in zip(*(x.tolist() for x in merged(*spans))):
        parts.append(text[at:a])
        at, count = b, count + 1
    return b"".join([*parts, text[at:]]), count


def with_cuts(docs: DataFrame, finish, schema) -> DataFrame:
    """``finish(table of a block's rows, what is left of each text or None, removed runs)`` of all rows, by block.

    Rows with a null doc_id have None: their text stays as it is.
    """
    spark = bounded(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    numbers = Numbers(n, size)
    place, key = fresh_names(docs.columns, "block", "key")
    names = ("doc_id", key, "text")
    hashed = F.xxhash64("text", F.col("doc_id").isNull(), "doc_id")
    texts = docs.withColumn(key, hashed).withColumn(place, F.pmod(F.col(key), F.lit(numbers.blocks))).repartition(n, place)
    records = texts.groupBy(place).applyInArrow(gram_records(numbers, names, place), GRAMS).repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    back = records.mapInArrow(shared_grams(numbers), BACK)
    stretches = texts.groupBy(place).cogroup(back.groupBy("block")).applyInArrow(stretch_records(numbers, names, place), GRAMS)
    covered = stretches.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(covered_stretches, COVERED)

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        block = Block(table, names)
        left, count = [None] * table.num_rows, [0] * table.num_rows
        parts = [unpack(blob)[0] for blob in spans.column("blob").to_pylist()]
        rank, first, last = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(rank, kind="stable")
        rank, first, last = rank[order], first[order], last[order]
        lo, hi = np.searchsorted(rank, block.rank), np.searchsorted(rank, block.rank, "right")
        for k, text, a, z in zip(block.rows, block.texts, lo.tolist(), hi.tolist()):
            left[k], count[k] = cut_out(text, (first[a:z], last[a:z]) if a < z else None)
        out = finish(table.drop_columns([place, key]), left, count)
        release()
        return out

    return texts.groupBy(place).cogroup(covered.groupBy("block")).applyInArrow(run, schema)


def removed_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""

    def finish(table: pa.Table, left: list, count: list) -> pa.Table:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        kept = [r if k is None else k for r, k in zip(raw, left)]
        cols = {"doc_id": table.column("doc_id"), "n_bytes": [len(r) for r in raw], "n_removed": [len(r) - len(k) for r, k in zip(raw, kept)], "n_spans": count}
        cols = {c: pa.array(v, pa.int64()) if isinstance(v, list) else v for c, v in cols.items()}
        return pa.table(cols | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return with_cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated stretches cut out of its text; n_chars follows; no row is dropped.

    Where a cut falls inside a character, the rest of that character goes too.
    """

    def finish(table: pa.Table, left: list, count: list) -> pa.Table:
        texts = [k.decode("utf-8", "ignore") if n else t for t, k, n in zip(table.column("text").to_pylist(), left, count)]
        put = {"text": texts} | ({"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in table.column_names else {})
        for name, values in put.items():
            k = table.column_names.index(name)
            table = table.set_column(k, name, pa.array(values, table.schema.field(k).type))
        return table

    return with_cuts(docs, finish, docs.schema)
