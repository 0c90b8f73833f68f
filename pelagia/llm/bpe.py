"""BPE encoding and decoding with tree concatenation.

Text is cut at white space into chunks, which no token crosses; each distinct
chunk is normalised, pre-split and encoded once per worker. Pre-split words are
encoded in lockstep: all words of an Arrow batch advance one merge per round in
numpy. A word longer than ``LEAF`` symbols is cut into halves down to leaves,
the leaves are encoded together with everything else, and neighbours are then
joined level by level: a growing window of tokens around each join is encoded
anew until its first and last token agree with both sides. Every adjacent token
pair is then one that BPE itself would leave, which makes the whole equal to
encoding the unsplit word.

Cases: null and empty texts have no tokens; texts of white space only, too.
Chunks that aren't composed (NFC), or have a code point that Python's Unicode
tables lack, are normalised and split by the tables of the tokenizers library,
which are of other Unicode versions.
Repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from pelagia.llm.common import bounded, map_rows, texts_of

#: Symbols in a leaf of the concatenation tree.
LEAF = 48
#: Chunks that a worker remembers, and characters and token bytes in them; beyond it starts afresh, so memory is bounded.
CACHE, CACHE_BYTES = 500_000, 48 << 20

NONE = np.int32(1 << 30)
#: Stands between the ids of chunks; no token has it.
NO_ID, BETWEEN = 0xFFFFFFFF, b"\xff" * 4


class Numbered(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


#: Fixed values of the vocabulary's file format: how its pre-tokenizer splits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def public_path(name: str) -> str:
    """Where the environment keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def unsure(text: str) -> bool:
    """Whether Unicode versions may differ about a text: it isn't composed, or Python's tables lack a code point."""
    if text.isascii():
        return False
    # a code point without a category isn't printable
    return not unicodedata.is_normalized("NFC", text) or (not text.isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text)))


class Merges:
    """Rank and result of a token pair, as an open-addressing table that numpy probes for many pairs at once."""

    BITS = 18

    def __init__(self, pairs: np.ndarray, results: np.ndarray):
        size = 1 << self.BITS
        while size < 4 * len(pairs):
            self.BITS += 1
            size = 1 << self.BITS
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.made = np.zeros(size, np.int32)
        keys = pairs[:, 0].astype(np.int64) << 20 | pairs[:, 1]
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.rank[slots[put]], self.made[slots[put]] = keys[put], put, results[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of each pair; rank NONE where the pair never merges or holds padding (-1)."""
        keys = (a.astype(np.int64) << 20 | b).ravel()
        bad = ((a < 0) | (b < 0)).ravel()
        slots = self.slot(keys)
        there = self.keys[slots]
        todo = np.flatnonzero((there != keys) & (there != -1) & ~bad)
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[todo]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        hit = (self.keys[slots] == keys) & ~bad
        return np.where(hit, self.rank[slots], NONE).reshape(a.shape), self.made[slots].reshape(a.shape)


class Bpe:
    """An encoder and decoder for one vocabulary file of the tokenizers format with word ends."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.leaf, self.limit = file["model"], leaf, cache
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_symbols()
        self.inner = np.array([vocab[s] for s in shown], np.int32)
        self.final = np.array([vocab[s + end] for s in shown], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
        self.merges = Merges(ids[:, :2], ids[:, 2])
        self.base = {int(i): (int(i),) for i in (*self.inner, *self.final)}  # each token's symbols
        for a, b, c in ids.tolist():
            self.base.setdefault(c, self.base[a] + self.base[b])
        self.split = regex.compile(SPLIT)
        self.split_flow = regex.compile(SPLIT + "| ")
        self.blank = regex.compile(f"[{SPACE}]+")
        self.their_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.their_split = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
        self.afresh()

    # --- the lockstep kernel ---

    def lockstep(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of short symbol rows, laid end to end, all merging at once: (tokens end to end, lengths)."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        got_rows, got_len, got_flat, at = [], [], [], 0
        while at < len(order):
            width = max(4, int(lengths[order[at]]) * 3 // 2)
            to = min(int(np.searchsorted(lengths[order], width, "right")), at + 32768)
            rows = order[at:to]
            for done, tokens in self._merge(flat, starts[rows], lengths[rows]):
                got_rows.append(rows[done])
                got_len.append((tokens >= 0).sum(1))
                got_flat.append(tokens[tokens >= 0])
            at = to
        if not got_rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        rows, n, tokens = np.concatenate(got_rows), np.concatenate(got_len), np.concatenate(got_flat)
        out = np.zeros(len(lengths), np.int64)
        out[rows] = n
        to = np.cumsum(out) - out
        placed = np.empty(len(tokens), np.int32)
        placed[np.repeat(to[rows], n) + np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)] = tokens
        return placed, out

    def _merge(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Yields (row numbers, their tokens padded with -1) as rows get done."""
        width = int(lengths.max())
        cols = np.arange(width + 1)
        inside = cols[None, :] < lengths[:, None]
        s = np.full((len(lengths), width + 1), -1, np.int32)
        s[inside] = flat[(starts[:, None] + cols[None, :])[inside]]
        rank, made = self.merges.find(s[:, :-1], s[:, 1:])
        live = np.arange(len(lengths))
        while len(live):
            best = rank.argmin(1)
            line = np.arange(len(live))
            going = rank[line, best] < NONE
            if not going.all():
                yield live[~going], s[~going]
                live, s, rank, made, best = live[going], s[going], rank[going], made[going], best[going]
                line = np.arange(len(live))
                if not len(live):
                    return
            new = made[line, best]
            shift = cols[None, :] + (cols[None, :] > best[:, None])
            pad = np.full((len(live), 1), -1, np.int32)
            s = np.take_along_axis(np.concatenate([s, pad], 1), shift, 1)
            s[line, best] = new
            at = shift[:, :-1]
            rank = np.take_along_axis(np.concatenate([rank, np.full_like(pad, NONE)], 1), at, 1)
            made = np.take_along_axis(np.concatenate([made, pad], 1), at, 1)
            rank[line, best], made[line, best] = self.merges.find(new, s[line, best + 1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1], made[left, best[left] - 1] = self.merges.find(s[left, best[left] - 1], new[left])

    def lockstep_rows(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        tokens, n = self.lockstep(np.concatenate(rows), np.array([len(r) for r in rows]))
        return np.split(tokens, np.cumsum(n)[:-1])

    # --- tree concatenation ---

    def encode_symbols(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """BPE of symbol rows of any length; long ones by halves, leaves and joins."""
        leaves: list[np.ndarray] = []
        trees: list[list[int]] = []  # of each row: its leaves
        for r in rows:
            n = 1
            while len(r) > n * self.leaf:
                n *= 2
            cuts = [len(r) * k // n for k in range(n + 1)]
            trees.append(list(range(len(leaves), len(leaves) + n)))
            leaves += [r[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = self.lockstep_rows(leaves)
        forest = [[parts[k] for k in t] for t in trees]
        while any(len(t) > 1 for t in forest):
            pairs = [(k, j) for k, t in enumerate(forest) for j in range(0, len(t), 2) if len(t) > 1]
            joined = self.join([(forest[k][j], forest[k][j + 1]) for k, j in pairs])
            level: dict[int, list[np.ndarray]] = {}
            for (k, _), row in zip(pairs, joined):
                level.setdefault(k, []).append(row)
            for k, t in level.items():
                forest[k] = t
        return [t[0] for t in forest]

    def join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Tokens of each pair's concatenated text, from the tokens of both sides."""
        out: list[np.ndarray | None] = [None] * len(pairs)
        todo, size = list(range(len(pairs))), 2
        while todo:
            windows = []
            for k in todo:
                a, b = pairs[k]
                near = [*a[-size:].tolist(), *b[:size].tolist()]
                windows.append(np.array([x for t in near for x in self.base[t]], np.int32))
            again = []
            for k, mid in zip(todo, self.lockstep_rows(windows)):
                a, b = pairs[k]
                whole_a, whole_b = size >= len(a), size >= len(b)
                if (whole_a or mid[0] == a[-size]) and (whole_b or mid[-1] == b[size - 1]):
                    out[k] = np.concatenate([a[:0] if whole_a else a[:-size], mid, b[:0] if whole_b else b[size:]])
                else:
                    again.append(k)
            todo, size = again, size * 2
        return out  # type: ignore[return-value]

    # --- texts ---

    def normal(self, text: str) -> str:
        """Composed and lower-cased, character by character (no word-final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk that holds special tokens or is unsure, and the ids of those tokens."""
        out: list[str | int] = []
        for k, p in enumerate(self.at_special.split(chunk) if self.at_special else [chunk]):
            if k % 2:
                out.append(self.special[p])
            elif unsure(p):
                out += [w for w, _ in self.their_split.pre_tokenize_str(self.their_normal.normalize_str(p))]
            else:
                out += self.split.findall(self.normal(p))
        return out

    def encode_words(self, words: list[str]) -> None:
        """Fill the word cache: short words in lockstep, long ones by tree concatenation."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.final[flat[ends]]
        long = np.flatnonzero(lengths > self.leaf)
        if len(long):
            for k, ids in zip(long.tolist(), self.encode_symbols([symbols[ends[k] + 1 - lengths[k] : ends[k] + 1] for k in long])):
                self.words[words[k]] = ids.astype("<u4").tobytes()
            short = lengths <= self.leaf
            symbols, words, lengths = symbols[np.repeat(short, lengths)], [w for w, ok in zip(words, short.tolist()) if ok], lengths[short]
        tokens, n = self.lockstep(symbols, lengths)
        packed, to = tokens.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        self.words.update(zip(words, map(packed.__getitem__, map(slice, [0, *to[:-1]], to))))

    def learn(self, new: list[str]) -> None:
        """Encode chunks not seen so far; their ids follow those of the chunks before."""
        odd = unsure(" ".join(new))
        marked = [k for k, c in enumerate(new) if ("<" in c and self.at_special and self.at_special.search(c)) or (odd and unsure(c))]
        apart = set(marked)
        line = " ".join([c for k, c in enumerate(new) if k not in apart] if marked else new)
        self.held += 6 * len(line)  # a token or less a character
        flow = self.split_flow.findall(self.normal(line)) if len(new) > len(marked) else []
        split = [self.pieces(new[k]) for k in marked]
        known = self.words
        fresh = list({w for w in flow if w not in known} - {" "} | {w for ws in split for w in ws if type(w) is str and w not in known})
        if fresh:
            self.encode_words(fresh)
        known[" "] = BETWEEN
        ids = np.frombuffer(b"".join(map(known.__getitem__, flow)), "<u4")
        between = ids == NO_ID
        rows = np.split(ids, np.flatnonzero(between)) if marked and len(new) > len(marked) else None
        if rows is None and not marked:
            ends = np.append(np.flatnonzero(between) - np.arange(len(new) - 1), len(ids) - len(new) + 1)
            self.put(ids[~between], np.diff(ends, prepend=0))
            return
        plain = iter([r[r != NO_ID] for r in rows or []])
        said = dict(zip(marked, (b"".join(known[w] if type(w) is str else w.to_bytes(4, "little") for w in ws) for ws in split)))
        all_ = [np.frombuffer(said[k], "<u4") if k in said else next(plain) for k in range(len(new))]
        self.put(np.concatenate(all_), np.array([len(r) for r in all_], np.int64))

    def put(self, ids: np.ndarray, count: np.ndarray) -> None:
        """Keep the ids of the next chunks, laid end to end."""
        total = self.stop[self.filled] + len(ids)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        self.ids[total - len(ids) : total] = ids
        end = self.filled + len(count)
        if end >= len(self.stop):
            self.stop = np.concatenate([self.stop, np.zeros(max(end, len(self.stop)), np.int64)])
        self.stop[self.filled + 1 : end + 1] = total - len(ids) + np.cumsum(count)
        self.filled = end

    def afresh(self) -> None:
        """Forget all chunks and words."""
        self.chunks, self.words = Numbered(), {}
        self.ids, self.stop, self.filled, self.held = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def cut(self, text: str) -> list[str]:
        """White-space chunks; Python's own split also cuts at U+001C-001F, which the vocabulary keeps."""
        parts = text.split()
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            parts = [p for p in self.blank.split(text) if p]
        return parts

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit values."""
        if self.filled > self.limit or len(self.words) > self.limit or self.held > CACHE_BYTES:
            self.afresh()
        cut = [self.cut(t) for t in texts]
        size = np.array([len(c) for c in cut], np.int64)
        chunk = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        if len(self.chunks) > self.filled:
            self.learn(list(islice(self.chunks, self.filled, None)))
        start = self.stop[chunk]
        count = self.stop[chunk + 1] - start
        ends = np.cumsum(count)
        packed = self.ids[np.repeat(start - ends + count, count) + np.arange(int(count.sum()))].tobytes()
        cuts = (4 * np.append(0, ends)[np.append(0, np.cumsum(size))]).tolist()
        return [packed[a:z] for a, z in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(p, "<u4").tolist() for p in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """As the vocabulary file has it: no decoder, so tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The worker's encoder; workers are reused, so its cache outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """General form: (id, ids array, decoded text) per row of ``df``.

    A null text gives an empty array and an empty string; row order and number stay.
    """
    bounded(df.sparkSession)
    import pyarrow as pa

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            packed = bpe.encode_packed(texts_of(b, text_col))
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the text decoded from them."""
    bounded(df.sparkSession)

    def make():
        bpe = loaded(path)
        names = {i: str(i) for i in bpe.tokens}

        def step(batch):
            n, ids_sha, dec_sha = [], [], []
            for p in bpe.encode_packed(texts_of(batch)):
                ids = np.frombuffer(p, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                dec_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": dec_sha}

        return step

    return map_rows(df.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
