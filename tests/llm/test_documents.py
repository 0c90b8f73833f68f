"""Document operators against brute force on a small, awkward table."""

import hashlib
import math
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pelagia.llm import bpe, common, edit_embedding, gif, langid, near_dup, packing, quality, suffix_dedup, suffix_sort

WORD_BPE = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component string, salt int"


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "lorem ipsum dolor amet sit".split() for b in "aeiou"]
    passage = " ".join(rng.choices(words, k=60))
    base = [" ".join(rng.choices(words, k=rng.randint(8, 120))) for _ in range(12)]
    near = base[0].split()
    near[len(near) // 2] = "other"
    out = [*base, " ".join(near), base[3], base[3].upper(), passage + " " + base[1], base[2] + " " + passage + " end"]
    return out + [None, "", "   \t\n", "one", "a b c d", "İstanbul ŞĞÜ \u00a0 日本語テキスト 🙂 \x00", "aa" * 6000, "the " * 3000, "x" + "aa" * 6000, None, "one"]


@pytest.fixture(scope="module")
def rows():
    return [(3 * k + 1, t, ["en", "de", None][k % 3], None, None, k, "c", 0) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_duplicates_brute_force(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_cell_links_are_exact():
    """A pair at the threshold is a link whatever its 8-bit slots say; one just below it is none."""
    rng = random.Random(2)
    whole = sorted(rng.sample(range(1 << 62), 700))

    def row(block, i, shingles):
        return (block, i, i, bytes([i] * near_dup.SLOTS), b"".join(x.to_bytes(8, "little") for x in shingles))

    assert near_dup.compare_cell((0, 0, 0), [row(0, 4, whole[:400]), row(0, 9, whole[:300])], 75) == [(4, 9)]
    assert near_dup.compare_cell((0, 0, 0), [row(0, 4, whole[:400]), row(0, 9, whole[:299])], 75) == []
    sets = {i: set(rng.sample(whole, 350)) if i % 3 else set(whole[: 300 + 12 * i]) for i in range(12)}
    for key, block in (((0, 0, 0), lambda i: 0), ((0, 0, 1), lambda i: i // 6)):
        got = near_dup.compare_cell(key, [row(block(i), i, sorted(s)) for i, s in sets.items()], 75)
        near = {(a, b) for a in sets for b in sets if a < b and (key[1] == key[2] or block(a) != block(b)) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
        assert near and set(got) <= near

        def groups(links):
            up = {i: {i} for i in sets}
            for a, b in links:
                both = up[a] | up[b]
                for i in both:
                    up[i] = both
            return {frozenset(g) for g in up.values()}

        assert groups(got) == groups(near)


def test_repeats_brute_force(docs, rows):
    seen, want = {}, {}
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            seen.setdefault(raw[i][k : k + 50], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed_digest(docs).collect()}
    assert got == want


def test_records_of_repeats_grow_as_the_text(spark, monkeypatch):
    """Blocks times buckets bound the records; wider blocks give the same result."""
    small, large = (suffix_dedup.Numbers(200, size) for size in (1 << 30, 10 << 30))
    for bits in ("gram_bucket", "stretch_bucket"):
        assert large.blocks << getattr(large, bits) <= 20 * (small.blocks << getattr(small, bits))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = random.Random(8)
    parts = ["".join(rng.choices("abcde ", k=90)) for _ in range(20)]
    docs = spark.createDataFrame([(i, "-".join(rng.choices(parts, k=3))) for i in range(80)], "doc_id long, text string")
    got = []
    for even in (1 << 30, 2000):
        monkeypatch.setattr(suffix_dedup, "EVEN", even)
        got.append(sorted(map(tuple, suffix_dedup.removed_digest(docs).collect())))
    assert got[0] == got[1] and sum(r[2] for r in got[0]) > 5000


@pytest.mark.parametrize("many", [2, 3, 1 << 30])
def test_repeats_of_many_blocks(spark, monkeypatch, many):
    """Small blocks and common grams, whose strings are dealt one by one; repeated rows and ids; columns with any name."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(many)
    word = lambda: "".join(rng.choices("etaoinshrd", k=rng.randint(1, 8)))
    phrase = " ".join(word() for _ in range(12))
    parts = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for k in range(150):
        t = [rng.choice([phrase, phrase[5:60], rng.choice(parts), " ".join(word() for _ in range(9)), "é" * 40, "ab" * 30]) for _ in range(rng.randint(0, 8))]
        rows.append((rng.randint(-5, 120), " ".join(t)))
    rows += rows[:9] + [(None, phrase * 3), (7, None)]
    docs = spark.createDataFrame([(i, t, "k", 1, t) for i, t in rows], "doc_id long, text string, key string, block int, _key string").repartition(4)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            if i is not None:
                seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    want, left = [], []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
        left.append((i, kept.decode("utf-8", "ignore")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, suffix_dedup.removed_digest(docs).collect()), key=key) == sorted(want, key=key)
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key) == sorted(left, key=key)


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"ab" * 300, b"a" * 500, bytes(range(256)) * 2])
def test_suffix_array(text):
    assert list(suffix_sort.suffix_array(text)) == sorted(range(len(text)), key=lambda k: text[k:])


def test_bpe_matches_the_library(docs, rows):
    tok = Tokenizer.from_file(bpe.public_path(WORD_BPE))
    tok.no_truncation(), tok.no_padding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(docs, bpe.public_path(WORD_BPE)).collect()}
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))), (t or "")[:40]


def test_packing_is_gapless_and_best_fit(docs, rows):
    tok = Tokenizer.from_file(bpe.public_path(WORD_BPE))
    tok.no_truncation(), tok.no_padding()
    bins, lengths = defaultdict(list), []
    got = packing.pack_documents(docs, bpe.public_path(WORD_BPE)).collect()
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]
        assert r["start"] == 4096 * r["piece"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths.append(r["length"])
    assert sum(lengths) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    open_ = []
    for n in sorted(lengths, reverse=True):  # best-fit decreasing, piece by piece
        fit = min((c for c in open_ if c >= n), default=None)
        if fit is not None:
            open_.remove(fit)
        open_.append((4096 if fit is None else fit) - n)
    assert len(bins) == len(open_)


def test_gif_round_trip(docs, rows):
    got = {r["doc_id"]: r for r in gif.digest_media(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), sha(pay), zlib.crc32(pay[-32:]))


def test_lzw_round_trip():
    for data in (b"", b"\x00", b"abc" * 5000, bytes(random.Random(1).randrange(256) for _ in range(9000))):
        assert bytes(gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).astype("uint8")) == data


@pytest.mark.parametrize("n", [1, 2, 255, 576, 3800])
def test_lzw_in_step_equals_one_by_one(n):
    rng = np.random.default_rng(n)
    rows = np.stack([rng.integers(0, 256, n), np.full(n, 7), np.arange(n) % 3, rng.integers(0, 4, n), np.arange(n) % 256]).astype(np.uint8)
    streams = gif.lzw_pack(*gif.lzw_codes(rows))
    assert streams == [gif.lzw_encode(r.tobytes()) for r in rows]
    samples, ok = gif.lzw_unpack(streams, n)
    assert ok.all() and (samples == rows).all()
    several = gif.lzw_encode(bytes(rng.integers(0, 256, 9000).astype(np.uint8)))  # clears on the way
    broken = [streams[0][:-1] + b"\xff", b"\x00" + streams[0][1:], several]
    for data in broken if n > 2 else []:
        samples, ok = gif.lzw_unpack([data, streams[1]], n)
        assert ok.tolist()[1] and (samples[1] == rows[1]).all()
        assert not ok[0] or (samples[0] == gif.lzw_decode(data, 8, n)).all()


def test_bad_gif_files():
    whole = gif.encode_files([b"\xff" * gif.FRAME])[0]
    for file in (whole[:40], b"GIF89a" + whole[6:10] + b"\0" + whole[11:13] + whole[781:], whole[:-30]):
        with pytest.raises(ValueError):
            gif.decode_files([file])


def gif_file(frames, palette, size=2):
    """A GIF of (left, top, width, height, delay, disposal, transparent, own palette, samples), LZW from the dictionary coder."""
    colours = lambda p: bytes(x for c in p + [(0, 0, 0)] * (256 - len(p)) for x in c)
    out = b"GIF89a" + struct.pack("<HHBBB", size, size, 0xF7, 0, 0) + colours(palette)
    for left, top, w, h, delay, disposal, key, own, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (key is not None), delay, key or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x87 if own else 0) + (colours(own) if own else b"") + b"\x08"
        data = gif.lzw_encode(bytes(samples))
        out += bytes([len(data)]) + data + b"\x00"
    return out + b"\x3b"


R, G, B, O = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)  # noqa: E741


def test_frames_by_transparency_and_disposal(spark):
    file = gif_file([(0, 0, 2, 2, 5, 0, None, None, [0] * 4), (1, 0, 1, 2, 7, 3, 2, None, [1, 2]), (0, 1, 2, 1, 9, 2, None, [B], [0, 0]), (0, 0, 1, 1, 1, 1, None, None, [1])], [R, G, B])
    want = [(0, 5, [R, R, R, R]), (5, 7, [R, G, R, R]), (12, 9, [R, R, B, B]), (21, 1, [G, R, O, O])]
    box = lambda c: (c[0] * 4 // 256 * 4 + c[1] * 4 // 256) * 4 + c[2] * 4 // 256
    stored = spark.createDataFrame([(1, 11, bytearray(file))], "doc_id long, n_bytes long, media binary")
    got = sorted(gif.frames_of(stored).collect(), key=lambda r: r["frame"])
    counts = [0] * 64
    assert len(got) == len(want)
    for r, (start, delay, screen) in zip(got, want):
        assert (r["start_cs"], r["delay_cs"], r["rgb"]) == (start, delay, bytes(x for c in screen for x in c))
        assert r["histogram"] == [sum(box(c) == k for c in screen) for k in range(64)]
        counts = [a + b for a, b in zip(counts, r["histogram"])]
    one = gif.describe(stored).collect()[0]
    assert (one["n_bytes"], one["payload_bytes"]) == (11, 9)
    assert one["feature"] == b"".join((c * 65535 // 16).to_bytes(2, "big") for c in counts).hex()


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in edit_embedding.fingerprint_documents(docs).collect()}
    prints = defaultdict(set)
    for k, (i, t, *_) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        put = n[:half]
        want = t[: len(t) - half] + put
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(want), k
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        prints[t].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_near_pairs_beside_the_smallest_id(spark, monkeypatch):
    """One slice agrees in all; the smallest id is near none of the others."""
    body = "the quick brown fox jumps over the lazy dog " * 3
    texts = {1: "0123456789" * 13, 2: body, 3: body + "x", 4: "yz" + body, 5: body, 6: "9876543210" * 13, 7: ""}
    prints = spark.createDataFrame([(k, "0" * 8 + f"{k:x}" * 56) for k in texts], "doc_id long, fingerprint string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(2, 3, 1), (2, 4, 2), (2, 5, 0), (3, 4, 3)}
    for block in (1024, 2):
        monkeypatch.setattr(edit_embedding, "BLOCK", block, raising=False)
        got = [tuple(r) for r in edit_embedding.near_pairs(prints, docs).collect()]
        assert len(got) == len(set(got)) and set(got) == want, block


def test_near_pairs_recall(spark):
    """Of all pairs within 10 % edits, by brute force, at least 0.9 are found at every length and none else."""
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]

    def edited(t, share):
        t = list(t)
        for _ in range(int(len(t) * share)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(([], [rng.choice("etaoin ")], [t[k], rng.choice("etaoin ")]))
        return "".join(t)

    rows = []
    for size in (100, 300, 800):
        for _ in range(40):
            t = " ".join(rng.choices(words, k=size))[:size]
            rows += [(size, x) for x in (t, edited(t, 0.05), edited(t, 0.1))]
    docs = spark.createDataFrame([(k, size, t) for k, (size, t) in enumerate(rows)], "doc_id long, size int, text string").repartition(4).cache()
    a, b = docs.selectExpr("doc_id first", "size", "text x"), docs.selectExpr("doc_id", "size other", "text y")
    near = a.join(b, a["first"] < b["doc_id"]).where("size = other").selectExpr("size", "first", "doc_id", "levenshtein(x, y) edits", "cast(greatest(length(x), length(y)) * 0.1D as int) most").where("edits <= most")
    want = defaultdict(set)
    for r in near.collect():
        want[r["size"]].add((r["first"], r["doc_id"], r["edits"]))
    prints = edit_embedding.fingerprint_documents(docs).select("doc_id", "fingerprint").cache()
    got = {tuple(r) for r in edit_embedding.near_pairs(prints, docs).collect()}
    assert len(want) == 3 and got <= set().union(*want.values())
    share = {size: len(got & pairs) / len(pairs) for size, pairs in want.items()}
    assert min(share.values()) >= 0.9, share


def test_language_and_quality_cases(docs, rows):
    path = bpe.public_path(langid.MODEL)
    got = {r["doc_id"]: r for r in langid.predict(docs, *langid.fit(docs, path), path).collect()}
    for i, t, *_ in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


@pytest.mark.parametrize("size", [30, 48, 49, 90, 255, 256, 257, 700])
def test_long_words_are_summed_over_all_segmentations(size):
    rng = random.Random(size)
    names = [*"abcde", "ab", "abc", "ea", "bcdea", "abcdeabcdeabcdea", langid.MARK + "a", "deabc"]
    pieces = langid.Pieces(names)
    logp = np.log(np.array([[rng.uniform(0.001, 0.05) for _ in range(3)] for _ in range(pieces.size)]))
    words = [langid.MARK + "".join(rng.choices(["abcde", "a", "b", "ea", "x"], k=size))[: n - 1] for n in (size, size // 2, 3)]

    def total(w, k, change=None):
        """Log sum over all segmentations, position by position, one piece's log probability changed."""
        f = [0.0]
        for e in range(1, len(w) + 1):
            x = []
            for s in range(max(0, e - 16), e):
                i = pieces.ids.get(w[s:e], pieces.size - 1 if e - s == 1 else None)
                if i is not None:
                    x.append(f[s] + logp[i, k] + (change[1] if change and change[0] == i else 0.0))
            f.append(max(x) + math.log(math.fsum(math.exp(v - max(x)) for v in x)))
        return f[-1]

    got = langid.forward(words, pieces, logp)
    assert np.allclose(got, [[total(w, k) for k in range(3)] for w in words], rtol=1e-12, atol=0)
    scorer = langid.Scorer(pieces, logp)
    scorer.learn({w[1:] for w in words})
    assert all(np.allclose(scorer.rows[scorer.at[w[1:]]], got[k], rtol=1e-12, atol=0) for k, w in enumerate(words))
    counts = np.zeros(pieces.size)
    langid.expect_into(counts, words[0], 2, pieces, logp[:, 1])
    for i in range(pieces.size):  # an expected count is the slope of the log sum
        slope = (total(words[0], 1, (i, 1e-5)) - total(words[0], 1, (i, -1e-5))) / 2e-5
        assert abs(counts[i] - 2 * slope) < 1e-4 * max(1, counts[i]), i


def test_quality_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(d, quality.fit(d, labels)).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert sum((r["score"] >= 0.5) == r["quality"] for r in got) > 0.9 * len(got)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = bpe.public_path(langid.MODEL)
    got = langid.predict(d, *langid.fit(d, path), path).where("held_out AND lang_pred <> 'und'").join(d.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)


def test_empty_tables(spark, empty):
    path = bpe.public_path(WORD_BPE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (near_dup.near_duplicates(empty), suffix_dedup.removed_digest(empty), bpe.digest_documents(empty, path), packing.pack_documents(empty, path), gif.digest_media(empty), edit_embedding.fingerprint_documents(empty), quality.score(empty, quality.fit(empty, labels)), langid.predict(empty, *langid.fit(empty, bpe.public_path(langid.MODEL)), bpe.public_path(langid.MODEL))):
        assert out.collect() == []


def test_null_ids_do_not_crash(spark):
    d = spark.createDataFrame([(None, "word " * 40, None, None, None, 1, "c", 0), (5, "word " * 40, None, None, None, 2, "c", 0)], SCHEMA)
    assert len(near_dup.near_duplicates(d).collect()) == 2
    assert len(suffix_dedup.removed_digest(d).collect()) == 2
    assert len(packing.pack_documents(d, bpe.public_path(WORD_BPE)).collect()) == 2
    assert len(edit_embedding.fingerprint_documents(d).collect()) == 2


def test_clashing_names(spark):
    rows = [(1, "one two three four five six seven", 1, "a", 2), (2, "one two three four five six seven", 3, "b", 4), (None, None, 5, "c", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept int, _kept string, KEEP int")
    got = near_dup.deduplicate(d)
    assert got.columns == d.columns and sorted((r["kept"], r["_kept"]) for r in got.collect()) == [(1, "a"), (5, "c")]


def test_equal_texts_score_alike(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts_ = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(50)]
    w = quality.train([t.encode() for t in texts_], np.array([k % 2 for k in range(50)], float))
    scorer = quality.Scorer(w)
    alone = [float(scorer.score([t])[0]) for t in texts_]
    assert alone == scorer.score(texts_).tolist() == scorer.score(texts_[::-1]).tolist()[::-1]


def test_quality_by_hand():
    """FTRL-proximal and the score of a text, one feature after another."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
    texts_ = [" ".join(rng.choices(words, k=rng.randint(1, 20))).encode() for _ in range(12)]
    y = [k % 2 for k in range(12)]
    got = quality.train(texts_, np.array(y, float), passes=2)
    size = 1 << quality.BITS
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def terms(t):
        places, counts = quality.features([t])
        out = defaultdict(float)
        for p in places.tolist():
            out[p] += quality.SCALE / counts[0]
        out[size] = 1.0
        return out

    for _ in range(2):
        for t, label in zip(texts_, y):
            x = terms(t)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z}
    assert all(abs(got[i] - v) < 1e-9 for i, v in want.items()) and np.count_nonzero(got) == sum(v != 0 for v in want.values())
    score = quality.Scorer(got).score([texts_[0].decode()])[0]
    assert abs(score - 1 / (1 + math.exp(-sum(want[i] * v for i, v in terms(texts_[0]).items())))) < 1e-9


def test_no_labels_keep_all(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).count() == len(rows)


def test_very_long_texts(spark):
    """A word of a megabyte, and megabytes of words."""
    rng = random.Random(4)
    word = "".join(rng.choices("etaoinsrhld", k=1 << 20))
    prose = " ".join("".join(rng.choices("etaoinsrhld", k=6)) for _ in range(300_000))
    d = spark.createDataFrame([(1, word, "en"), (2, prose, "en"), (3, prose + " end", "en"), (4, "short text of a few words", "de")], "doc_id long, text string, lang string")
    path = bpe.public_path(WORD_BPE)
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.digest_documents(d, path).collect()}
    assert got[1] == len(tok.encode(word, add_special_tokens=False).ids) and got[2] == len(tok.encode(prose, add_special_tokens=False).ids)
    cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removed_digest(d).collect()}
    assert cut == {1: 0, 2: 0, 3: len(prose), 4: 0}
    assert {r["doc_id"] for r in near_dup.near_duplicates(d).where("kept").collect()} == {1, 2, 4}
    assert {r["doc_id"]: r["payload_bytes"] for r in gif.digest_media(d).collect()}[1] == -(-len(word) // 576) * 576
    pieces = bpe.public_path(langid.MODEL)
    assert langid.predict(d, *langid.fit(d, pieces), pieces).count() == 4
    assert edit_embedding.fingerprint_documents(d).count() == 4


def test_every_code_point_as_the_library():
    """Alone, among letters and beside digits; those that only one of the Unicode tables has, too."""
    path = bpe.public_path(WORD_BPE)
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = bpe.Bpe(path)
    for at in range(0, len(every), 100_000):
        texts = [f"a{c}b {c}{c}1" for c in every[at : at + 100_000]]
        theirs = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [t for t, a, b in zip(texts, own.encode(texts), theirs) if a != b] == []
    # marks in any order, and pairs that compose
    marks = [c for c in every if unicodedata.combining(c)]
    rng = random.Random(8)
    heaps = ["e" + "".join(rng.choices(marks, k=rng.randint(1, 4))) + "x" for _ in range(30_000)]
    heaps += [unicodedata.normalize("NFD", c) + "s" for c in every if unicodedata.decomposition(c)]
    assert own.encode(heaps) == [e.ids for e in tok.encode_batch(heaps, add_special_tokens=False)]
    mixed = ["".join(every[c : c + 40]) + "<|endoftext|>x" for c in range(0, len(every), 40)]
    assert own.encode(mixed) == [e.ids for e in tok.encode_batch(mixed, add_special_tokens=False)]


def test_ids_and_text_of_documents(docs, rows):
    path = bpe.public_path(WORD_BPE)
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, path).collect()}
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [2, 1024])
def test_remaining_links_of_large_buckets(spark, monkeypatch, block):
    """Texts with much in common, some of them near copies of each other and not of the smallest id."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    common = [word() for _ in range(60)]
    rows, sets = [], {}
    for k in range(40):
        own = [word() for _ in range(30)]
        rows.append((3 * k, common + own))
        if k % 4 == 0:
            rows.append((3 * k + 1, common + own[:27] + [word()]))
    rows = [(i, " ".join(t)) for i, t in rows]
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(d).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(got)


def test_crowded_bands_and_centres(spark, monkeypatch):
    """One band and one id in nine of ten rows: the same buckets and components, whichever way they take."""
    crowd = b"\x07" * 8
    sets = spark.createDataFrame([(i, (crowd if i % 10 else i.to_bytes(8, "big")) + (i // 3).to_bytes(8, "little")) for i in range(1, 2001)], "id long, bands binary")
    by_hot = [{(bytes(r["band"]), r["id"], r["centre"]) for r in near_dup.buckets_of(sets, 2, hot).collect()} for hot in (2, 64)]
    want = {(crowd, i, 1) for i in range(1, 2001) if i % 10}
    pairs = defaultdict(list)
    for i in range(1, 2001):
        pairs[i // 3].append(i)
    want |= {((k).to_bytes(8, "little"), i, min(v)) for k, v in pairs.items() for i in v if len(v) > 1}
    assert by_hot == [want, want]
    rng = random.Random(3)
    links = [(5, i) for i in range(6, 1800)] + [(i, i + 1) for i in range(3000, 3400)] + [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(250)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for a, b in links if a != b for x in (a, b)}
    for nodes in (16, near_dup.NODES):
        monkeypatch.setattr(near_dup, "NODES", nodes)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        got = {r["id"]: r["component"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


def shuffled(spark):
    """Shuffle files on this machine, with their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}


def left_over(spark, before, limit=0):
    """Bytes of new shuffle files, after at most 10 s in which they may go."""
    for _ in range(50):
        left = sum(n for f, n in shuffled(spark).items() if f not in before)
        if left <= limit:
            break
        time.sleep(0.2)
    return left


def test_settled_frames_leave_no_shuffle_files(spark):
    """The same rows, no shuffle files, the frame before still of use, the session's setting as it was."""
    for was in (None, "false", "true"):
        if was:
            spark.conf.set(common.FREE_SHUFFLES, was)
        d = spark.range(5000).select((F.col("id") % 700).alias("k"), "id").groupBy("k").agg(F.sum("id").alias("n"))
        before = shuffled(spark)
        got = common.settle(d)
        assert left_over(spark, before) == 0
        want = sorted((k, sum(range(k, 5000, 700))) for k in range(700))
        assert sorted(map(tuple, got.collect())) == want
        assert [sorted(map(tuple, d.collect())) for _ in range(2)] == [want, want]
        assert spark.conf.get(common.FREE_SHUFFLES) == (was or "false")
    spark.conf.unset(common.FREE_SHUFFLES)


def test_near_dedup_holds_one_step_of_shuffles(spark):
    """Texts go through two shuffles; neither is there when the result is planned."""
    rng = random.Random(8)
    texts = [[f"{rng.randrange(1 << 40):x}" for _ in range(200)] for _ in range(150)]
    rows = [(3 * k + c, " ".join(t[:190] + [str(c)] * 10)) for k, t in enumerate(texts) for c in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert d.count() == len(rows)
    before = shuffled(spark)
    got = near_dup.deduplicate(d)
    assert left_over(spark, before, 100_000) < sum(len(t) for _, t in rows) / 10
    assert sorted(r["doc_id"] for r in got.collect()) == [3 * k for k in range(150)]
