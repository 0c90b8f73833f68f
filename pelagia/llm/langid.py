"""Language identification by unigram pieces with all segmentations summed.

A fixed public vocabulary gives the pieces. Each language has its own piece
probabilities, learned by expectation-maximisation on a bounded sample of
labelled texts. A word's probability in a language is the sum over all ways to
cut it into pieces (forward algorithm in log space); a text's is the product
over its words. Each distinct word is summed once per worker, for all languages
together.

Cases: ``und`` for a null text or one without any letter (score 0). With nothing
to learn from, every text is ``und``. Ties take the language that sorts first.
Repeated rows are predicted alike; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, filter_rows, freed, fold_hash, held_out, map_rows, settle, texts_of

#: Texts per language, about, that the probabilities are learned from.
SAMPLE = 1500
ROUNDS = 2
MARK = "▁"
#: Longest piece in MODEL's vocabulary; another vocabulary brings its own.
MAX_PIECE = 16
#: Bits of a code point in a trie key.
CHARACTER_BITS = 21
#: Positions of a word whose edges are held at once.
STRETCH = 256
#: Words, and characters in them, that a scorer remembers; characters that advance together, about.
CACHE, CACHE_CHARS, TOGETHER = 300_000, 8_000_000, 1 << 17
SMOOTH = 0.5
UNKNOWN_SHARE = 1e-7

MODEL = "piece_bpe_32k.model"


def vocabulary(path: str) -> list[str]:
    """The pieces of a public vocabulary file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Pieces:
    """Cuts words into lattice edges over the vocabulary, held as a trie in sorted arrays."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces) + 1  # the last id: any other single character
        self.longest = max(map(len, pieces), default=1)
        nodes, piece_of = {}, [-1]  # (node, character) to node; node to the piece that ends there
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                after = nodes.setdefault(node << CHARACTER_BITS | ord(c), len(piece_of))
                if after == len(piece_of):
                    piece_of.append(-1)
                node = after
            piece_of[node] = i
        keys = np.array([*nodes, np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([*nodes.values(), 0], np.int64)[order]
        self.piece = np.array(piece_of, np.int64)

    def lattice(self, words: list[str], after: int = 0, until: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, row, start, piece) of all pieces in the marked words that end in (after, until], ordered by end and row.

        All positions that are still on a path go down the trie together, a character a round.
        """
        low = max(0, after - self.longest + 1)
        parts = [w[low:until] for w in words]
        size = np.array([len(x) for x in parts], np.int64)
        char = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        stops = np.cumsum(size)
        row = np.repeat(np.arange(len(parts)), size)
        stop, shift = stops[row], low - (stops - size)[row]  # the word's end; its places less those in ``char``
        start, node, found = np.arange(len(char)), np.zeros(len(char), np.int64), []
        for k in range(1, self.longest + 1):
            key = node << CHARACTER_BITS | char[start + k - 1]
            place = np.searchsorted(self.keys, key)
            known = self.keys[place] == key
            node = self.child[place]
            piece = np.where(known, self.piece[node], -1)
            if k == 1:  # every character is an edge, whether the vocabulary has it or not
                found.append((start, k, np.where(piece < 0, self.size - 1, piece)))
            elif (piece >= 0).any():
                found.append((start[piece >= 0], k, piece[piece >= 0]))
            on = known & (start + k < stop[start])
            start, node = start[on], node[on]
            if not len(start):
                break
        at = np.concatenate([f[0] for f in found])
        piece = np.concatenate([f[2] for f in found])
        begin = at + shift[at]
        end = begin + np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        order = np.flatnonzero(end > after)
        order = order[np.argsort(end[order] * len(words) + row[at[order]], kind="stable")]
        return end[order], row[at[order]], begin[order], piece[order]

    def edges(self, word: str, after: int = 0, until: int | None = None) -> list[tuple[int, int, int]]:
        """(end, start, piece) of all pieces in one marked word that end in (after, until], ordered by end."""
        end, _, start, piece = self.lattice([word], after, until)
        return list(zip(end.tolist(), start.tolist(), piece.tolist()))


def summed(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of the sums of exp(terms) over runs that begin at ``first``."""
    top = np.maximum.reduceat(terms, first)
    size = np.diff(np.append(first, len(terms)))
    return top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, size, 0)), first))


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def forward(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log probability of each marked word in each language, summed over segmentations.

    All words advance by end position together: position ``e`` of every word
    gathers the edges that end there. Only the last positions that a piece can
    reach back to are kept, and edges of ``STRETCH`` positions, for words of any length.
    """
    out = np.zeros((len(words), logp.shape[1]))
    if not words:
        return out
    lengths, kept = np.array([len(w) for w in words]), pieces.longest + 1
    alpha = np.full((len(words), kept, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for base in range(0, int(lengths.max()), STRETCH):
        live = np.flatnonzero(lengths > base)
        end, row, start, piece = pieces.lattice([words[r] for r in live.tolist()], base, base + STRETCH)
        row, start, last = live[row], start % kept, int(end[-1])
        cuts = np.searchsorted(end, np.arange(base + 1, last + 2))
        for e in range(base + 1, last + 1):
            a, b = cuts[e - base - 1], cuts[e - base]
            r = row[a:b]
            first = run_starts(r)
            here, sums = r[first], summed(alpha[r, start[a:b]] + logp[piece[a:b]], first)
            alpha[here, e % kept] = sums
            ended = lengths[here] == e
            out[here[ended]] = sums[ended]
    return out


def by_character(words: list[str], points: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word as single characters, its characters that aren't known, and all of them."""
    char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    place = np.searchsorted(points, char)
    seen = np.append(points, -1)[place] == char
    size = np.array([len(w) for w in words])
    value = np.stack([logp[np.where(seen, place, len(points))], ~seen, np.ones(len(char))], 1)
    return np.add.reduceat(value, np.cumsum(size) - size)


class Scorer:
    """Scores texts; remembers the log probabilities of words it has seen."""

    def __init__(self, pieces: Pieces, logp: np.ndarray, background: tuple[np.ndarray, np.ndarray] | None = None):
        self.pieces, self.logp, self.background = pieces, logp, background
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, logp.shape[1] + 3 * (background is not None)))
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        if len(self.at) > CACHE or self.chars > CACHE_CHARS:
            self.at.clear()
            self.chars = 0
        new = sorted((w for w in words if w not in self.at), key=len)
        k = 0
        while k < len(new):
            part, size = [], 0
            while k < len(new) and len(part) < 8192 and size < TOGETHER:
                part.append(new[k])
                size += min(len(new[k]) + 1, STRETCH)
                self.chars += len(new[k])
                k += 1
            base = len(self.at)
            while base + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            marked = [MARK + w for w in part]
            self.rows[base : base + len(part), : self.logp.shape[1]] = forward(marked, self.pieces, self.logp)
            if self.background is not None:
                self.rows[base : base + len(part), -3:] = by_character(marked, *self.background)
            self.at.update(zip(part, range(base, base + len(part))))

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text in each language, and what ``by_character`` gives if there is a background."""
        cut = [t.lower().split() for t in texts]
        self.learn(set().union(*cut))
        get = self.at.__getitem__
        total = np.zeros((len(texts), self.rows.shape[1]))
        for k, words in enumerate(cut):
            if words:
                total[k] = self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return total

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its posterior for each text."""
        total = self.sums(texts)[:, : self.logp.shape[1]]
        best = total.argmax(1)
        return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)

    def known(self, texts: list[str], least: float) -> np.ndarray:
        """Is a text in one of the languages: in their characters, half of its words better explained by pieces than by single characters, and sure?"""
        cut = [t.lower().split() for t in texts]
        self.learn(set().union(*cut))
        get, out = self.at.__getitem__, np.zeros(len(texts), bool)
        for k, words in enumerate(cut):
            if words:
                rows = self.rows[np.fromiter(map(get, words), np.int64, len(words))]
                total = rows.sum(0, dtype=np.float64)
                own, best = total[:-3], int(total[:-3].argmax())
                sure = 1 / np.exp(own - own[best]).sum() >= least
                out[k] = sure and 2 * total[-2] <= total[-1] and 2 * (rows[:, best] >= rows[:, -3]).sum() >= len(words)
        return out


def learned_from(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame | None]:
    """Languages, and (lang, text) of the about ``sample`` texts of each that models learn from, outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None
    share = F.create_map(*[x for n in langs for x in (F.lit(n), F.lit(min(1.0, sample / sizes[n])))])
    return langs, known.where(fold_hash(F.col("doc_id"), 7) < share[F.col("lang")]).select("lang", "text")


def alphabet(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Code points in order and the log probability of each, of any other one last: a background of single characters.

    Learned from the texts of all languages together, a word's mark counted as one of
    its characters. One number per character reaches the driver.
    """
    _, taken = learned_from(docs, sample)

    def run(batches):
        from collections import Counter

        count: Counter = Counter()
        for b in batches:
            for t in texts_of(b):
                words = t.lower().split()
                count.update("".join(words))
                count[MARK] += len(words)
        yield pa.RecordBatch.from_arrays([pa.array(map(ord, count), pa.int64()), pa.array(count.values(), pa.int64())], ["c", "n"])

    rows = sorted((r["c"], r["n"]) for r in taken.mapInArrow(freed(run), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()) if taken is not None else []
    points, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows] + [0], float) + SMOOTH
    return points, np.log(n / n.sum())


def fit(docs: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every piece in each, from rows outside the held-out fold.

    Learns from about ``sample`` texts per language, chosen by a hash of the id.
    What comes back to the driver is one number per piece and language.
    """
    spark = bounded(docs.sparkSession)
    langs, taken = learned_from(docs, sample)
    pieces = vocabulary(path)
    count = Pieces(pieces).size
    if taken is None:
        return [], np.zeros((count, 0))

    def words(batches):
        from collections import Counter

        tally: dict[str, Counter] = {}
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), texts_of(b)):
                tally.setdefault(n, Counter()).update(t.lower().split())
        for n, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(c)), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])

    counted = settle(taken.mapInArrow(freed(words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    logp = np.full((count, len(langs)), -9.0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, langs, logp))

        def expect(batches):
            names, order, now = shared.value
            model, place = Pieces(names), {n: k for k, n in enumerate(order)}
            got: dict[str, np.ndarray] = {}
            for b in batches:
                lang, word = (np.array(b.column(k).to_pylist(), object) for k in range(2))
                times = b.column(2).to_numpy().astype(float)
                for n in sorted(set(lang)):
                    at = np.flatnonzero(lang == n)
                    expect_words(got.setdefault(n, np.zeros(model.size)), [MARK + w for w in word[at]], times[at], model, now[:, place[n]])
            for n, v in got.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "piece", "n"])

        total = np.full((count, len(langs)), SMOOTH)
        for r in counted.mapInArrow(freed(expect), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            total[r["piece"], langs.index(r["lang"])] += r["n"]
        logp = np.log(total / total.sum(0))
        logp[-1] = np.log(UNKNOWN_SHARE)
    return langs, logp


def expect_into(out: np.ndarray, w: str, times: float, model: Pieces, logp: np.ndarray) -> None:
    """Add the expected piece counts of one marked word under one language."""
    expect_words(out, [w], np.array([times], float), model, logp)


def expect_words(out: np.ndarray, words: list[str], times: np.ndarray, model: Pieces, logp: np.ndarray) -> None:
    """Add the expected piece counts of marked words under one language (forward-backward in logs)."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    k = 0
    while k < len(order):
        part, size = [], 0
        while k < len(order) and (not part or len(part) < 8192 and size < TOGETHER and len(words[order[k]]) <= STRETCH):
            part.append(order[k])
            size += len(words[order[k]])
            k += 1
        if len(words[part[-1]]) > STRETCH:
            expect_long(out, words[part[-1]], float(times[part[-1]]), model, logp)
            part.pop()
        if part:
            expect_batch(out, [words[r] for r in part], times[part], model, logp)


def expect_batch(out: np.ndarray, words: list[str], times: np.ndarray, model: Pieces, logp: np.ndarray) -> None:
    """Expected counts of words of bounded length, which advance together."""
    lengths = np.array([len(w) for w in words])
    end, row, start, piece = model.lattice(words)
    most = int(lengths.max())
    f = np.full((len(words), most + 1), -np.inf)
    f[:, 0] = 0.0
    p = logp[piece]
    cuts = np.searchsorted(end, np.arange(1, most + 2))
    for e in range(most):
        a, b = cuts[e], cuts[e + 1]
        first = run_starts(row[a:b])
        f[row[a:b][first], e + 1] = summed(f[row[a:b], start[a:b]] + p[a:b], first)
    back = np.full_like(f, -np.inf)
    back[np.arange(len(words)), lengths] = 0.0
    order = np.argsort(start * len(words) + row, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(most + 1))
    for s in reversed(range(most)):
        o = order[cuts[s] : cuts[s + 1]]
        first = run_starts(row[o])
        back[row[o][first], s] = summed(back[row[o], end[o]] + p[o], first)
    share = np.exp(f[row, start] + p + back[row, end] - f[row, lengths[row]])
    out += np.bincount(piece, share * times[row], len(out))


def expect_long(out: np.ndarray, w: str, times: float, model: Pieces, logp: np.ndarray) -> None:
    """Expected counts of one long word, the edges of ``STRETCH`` positions at a time."""
    m = len(w)
    f, b = np.full(m + 1, -np.inf), np.full(m + 1, -np.inf)
    f[0] = b[m] = 0.0
    for base in range(0, m, STRETCH):
        for e, s, i in model.edges(w, base, base + STRETCH):
            f[e] = np.logaddexp(f[e], f[s] + logp[i])
    for base in reversed(range(0, m, STRETCH)):
        for e, s, i in reversed(model.edges(w, base, base + STRETCH)):
            out[i] += times * np.exp(f[s] + logp[i] + b[e] - f[m])
            b[s] = np.logaddexp(b[s], b[e] + logp[i])


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    spark = bounded(docs.sparkSession)
    shared = spark.sparkContext.broadcast((vocabulary(path), langs, logp))  # vocabulary x languages

    def make():
        names, order, model = shared.value
        scorer = Scorer(Pieces(names), model) if order else None

        def step(batch):
            texts = texts_of(batch)
            letters = [any(map(str.isalpha, t)) for t in texts]
            if scorer is None:
                best, p = np.zeros(len(texts), int), np.zeros(len(texts))
                letters = [False] * len(texts)
            else:
                best, p = scorer.score(texts)
            pred = [order[k] if ok else "und" for k, ok in zip(best.tolist(), letters)]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pred, "score": np.where(letters, p, 0.0)}

        return step

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


def keep_known(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """Rows in one of the learned languages; all columns stay.

    A text stays if at least half of its characters were learned, one language has a
    posterior of at least ``least``, and its pieces explain at least half of the words
    as well as single characters do. So letter junk goes, and texts in languages that
    weren't learned; a few odd words, however long, don't matter.
    """
    langs, logp = fit(docs, path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(path), langs, logp, alphabet(docs)))  # vocabulary x languages, and the characters

    def make():
        names, order, model, background = shared.value
        scorer = Scorer(Pieces(names), model, background) if order else None

        def mask(batch):
            texts = texts_of(batch)
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            return letters & scorer.known(texts, least) if scorer else np.zeros(len(texts), bool)

        return mask

    return filter_rows(docs, make)
