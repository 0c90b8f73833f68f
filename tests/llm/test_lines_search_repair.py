"""Line dedup, ranked search and conversation repair against brute force on awkward rows."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pelagia.llm import chat_repair, line_dedup, search

DOC = "doc_id long, text string, row long, pos int, h1 long, first long, keep string"
ITEM = "item_id long, text string, term string, rank int, item long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def table(spark, rows, ddl, parts=5):
    """The rows with the other columns of the schema, whose names clash with inner ones."""
    width = len(ddl.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], ddl).repartition(parts)


# --- line dedup ---------------------------------------------------------------


def line_rows():
    rng = random.Random(3)
    pool = [f"  The quick line {i}  " for i in range(60)] + ["Common LINE of all É"] * 20 + ["short", "", "Élan ABCDEFGHIJ", "élan abcdefghij"]
    rows = [(d * 3, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"uniq {d} {rng.random()}" for _ in range(rng.choice([0, 1, 3, 30, 400])))) for d in range(60)]
    long = "\n".join([f"uniq line here {i}" for i in range(3000)] + ["Common LINE of all É"] + [f"late line here {i}" for i in range(3000)])
    return [*rows, (500, None), (501, ""), (None, "Common LINE of all É\nx"), (9, rows[3][1]), (9, rows[3][1]), (9, "Common LINE of all É\nother line longer"), (700, long), (701, long), (702, "\n" * 5000)]


def line_brute(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else ():
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or first.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 60, 4])  # 60 and 4 send the common line, or most, round the range exchange
def test_lines_brute_force(spark, hot):
    rows = line_rows()
    df = table(spark, rows, DOC)
    got = line_dedup.deduplicate(df, line_dedup.keep_bitmaps(df, hot=hot)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == line_brute(rows)


def test_one_line_in_nine_tenths_of_all_rows(spark):
    rows = [(d, "one line that all of them have" if d % 10 else f"another line {d}") for d in range(2000)]
    df = table(spark, rows, DOC)
    lines = line_dedup.line_hashes(df).cache()
    assert line_dedup.frequent(lines).count() == 1
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_digest(df).collect()}
    assert got == {d: int(d % 10 > 0 and d > 1) for d in range(2000)}


def test_bitmap_forms(spark):
    """Bits where drops are many, runs where they are few and far; both read back."""
    few, many = [100_000], [k for k in range(3000) if k % 3]
    df = spark.createDataFrame([(few, [str(k) for k in range(100_010)]), (many, [str(k) for k in range(3001)])], "gone array<int>, lines array<string>")
    starts, stops = line_dedup.runs_of(F.col("gone"))
    made = df.select("gone", "lines", starts.alias("starts"), stops.alias("stops")).withColumn("keep", line_dedup.bitmap(F.col("starts"), F.col("stops")))
    got = made.select("gone", "lines", "keep", line_dedup.kept_lines(F.col("lines"), F.col("keep")).alias("kept")).collect()
    assert [(r["keep"][0], len(r["keep"])) for r in got] == [(1, 9), (0, 376)]
    for r in got:
        gone = set(r["gone"])
        assert r["kept"] == [x for k, x in enumerate(r["lines"]) if k not in gone]


def test_lines_of_an_empty_table_and_without_repeats(spark):
    assert line_dedup.line_digest(table(spark, [], DOC)).collect() == []
    assert [tuple(r) for r in line_dedup.line_digest(table(spark, [(1, "a line alone")], DOC)).collect()] == [(1, 1, 0, sha("a line alone"))]


# --- ranked search --------------------------------------------------------------


def search_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)] + ["Été", "naïve", "ÉCOLE", "X1"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))

    rows = [(d * 3 - 100, text(rng.choice([0, 1, 5, 20, 100, 400]))) for d in range(200)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(None, text(30)), (9000, None), (9001, "... --"), (9002, " ".join(["w3"] * 5000)), (5001, text(20)), (5002, rows[7][1])]
    items = [(i, text(8)) for i in range(25)] + [(30, None), (31, "zzz unknown"), (None, "w1 w2"), (3, "w150"), (32, rows[7][1])]
    return rows, items


def search_brute(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counts = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_words = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df, asked, out = Counter(w for _, c in counts for w in c), defaultdict(set), []
    for i, t in items:
        asked[i].update(terms(t))
    for i, ts in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most, piece, block", [(1 << 20, 4 << 20, 200_000), (400, 64, 60), (3000, 1000, 7)])
def test_search_brute_force(spark, most, piece, block):
    """One segment a task, or many; texts cut into pieces; items in many blocks."""
    rows, items = search_rows()
    docs = table(spark, rows, DOC)
    size = search.sizes(docs)
    index = search.build_index(docs, size, most, piece)
    assert index.agg(F.sum("n_docs")).first()[0] == size[0]
    got = search.search(index.cache(), table(spark, items, ITEM, 2), size, 10, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == search_brute(rows, items)


def test_bytes_bound_impacts():
    import numpy as np

    tf, n = np.meshgrid(np.array([1, 2, 3, 10, 1000, 10**6]), np.array([1, 5, 100, 10**4, 10**7]))
    exact = search.impacts(tf.ravel().astype(np.int64), n.ravel().astype(np.int64), 1000, 10**5)
    level = search.rounded(exact)
    assert (search.LOWER[level] <= exact).all() and (exact <= search.UPPER[level]).all()
    assert (search.rounded(np.arange(search.TOP)) <= 255).all()


def test_search_of_empty_tables(spark):
    rows, items = search_rows()
    assert search.rank_documents(table(spark, [], DOC), table(spark, items, ITEM)).collect() == []
    assert search.rank_documents(table(spark, rows, DOC), table(spark, [], ITEM)).collect() == []
    assert search.rank_documents(table(spark, [(1, None), (2, "!")], DOC), table(spark, items, ITEM)).collect() == []


# --- conversation repair ----------------------------------------------------------


def cheapest(turns):
    """The least (cost, audit) over (initial, must go, truncated), letter by letter."""
    after = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}

    @functools.cache
    def go(i, state, added):
        ways = [(0, "")] if i == len(turns) and state in ("", "a") else []

        def way(cost, letter, *to):
            rest = go(*to)
            ways.append((rest[0] + cost, letter + rest[1]))

        if added < 2:
            for r in after[state] - {"s"}:
                way(2, "I", i, r, added + 1)
        if i < len(turns):
            initial, gone, cut = turns[i]
            way(3, "D", i + 1, state, 0)
            if not gone and initial in after[state]:
                way(cut, "K", i + 1, initial, 0)
            for r in after[state] - {"s"} if not gone else ():
                way(2 + cut, "R", i + 1, r, 0)
        return min(ways) if ways else (10**9, "")

    return go(0, "", 0)


@pytest.mark.parametrize("held", [1, 3, 64])
def test_cheapest_edits(monkeypatch, held):
    monkeypatch.setattr(chat_repair, "HELD", held)
    rng = random.Random(held)
    for _ in range(1500):
        turns = [(rng.choice("ssuuuaaat"), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14, 30]))]
        plan, edits = chat_repair.Repair(), []
        for initial, gone, cut in turns:
            edits += plan.turn({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[initial], "x", gone, cut)
        rest, cost = plan.finish()
        edits += rest
        assert (cost, "".join(e for e, _, _ in edits)) == cheapest(tuple(turns)), turns
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in edits if role))


def test_a_long_conversation_is_held_in_part():
    rng, plan = random.Random(1), chat_repair.Repair()
    for k in range(20_000):
        plan.turn(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.random() < 0.1, rng.random() < 0.3)
        assert max(n.depth for _, n, _, _ in plan.minima.values()) - plan.root.depth < 1000, k


CONV = "conv_id long, turn long, role string, text string, digest string, mark int, at long, step long"


def talk_rows():
    rng = random.Random(8)
    texts = ["Hi there.", "What is it?", "no end", "  \t", "", None, "Yes!", "a.b!c? \n", "Again."]
    rows = []
    for c in range(60):
        turns = rng.sample(range(40), rng.choice([1, 2, 3, 6, 12]))
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "user"]), rng.choice(texts)) for t in turns]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (70, None, "user", "Hello."), (70, None, None, None), (71, 5, "user", "One."), (71, 5, "assistant", "Two."), (71, 5, "user", "One.")]
    return rows + [(99, t, "user" if t % 2 == 0 else "assistant", f"{t} said.") for t in range(700)] + [(98, t, "user", "The same.") for t in range(300)]


def repaired(rows):
    """Brute force of damage, faults and repair; the cheapest edits by letters."""
    blank = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c]
        fault = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        if fault:
            row = (t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            by[c] += [row] * (1 + (fault == 3))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        known, seen, marks, counts = [t for t, _, _ in turns if t is not None], set(), [], Counter()
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[kind] += 1
            marks.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(tuple(marks)) if len(marks) < 200 else (None, None)
        state, k, lines = "", 0, []
        for letter in audit or "":
            if letter == "D":
                k += 1
                continue
            new = turns[k][1][:1] if letter == "K" else "a" if state == "u" else "u"
            name, text = {"u": "user", "a": "assistant"}.get(new), "" if letter == "I" else turns[k][2]
            lines.append(f"{turns[k][1] if letter == 'K' else name}:{text}")
            k, state = k + (letter != "I"), new
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines)) if audit is not None else None))
    return {r[0]: r for r in out}


def test_repair_brute_force(spark):
    rows = talk_rows()
    got = {r[0]: tuple(r) for r in chat_repair.digest(chat_repair.repair(chat_repair.damage(table(spark, rows, CONV)))).collect()}
    want = repaired(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert all(b is None or a == b for a, b in zip(got[c], w) if w[6] is not None or b is not None) and (w[6] is None or got[c] == w), (got[c], w)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "Well"), (2, 0, None, None)]
    edits = chat_repair.repair(table(spark, rows, CONV, 1)).collect()
    by = defaultdict(list)
    for r in edits:
        by[r["conv_id"]].append((r["edit"], r["role"], r["text"]) if r["edit"] else (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"]))
    assert by == {1: [("D", None, None)] * 3 + [(0, 0, 1, 1, 2, 9)], 2: [(0, 0, 0, 0, 0, 0)]} or by[1][-1][-1] == cheapest((("a", False, False), ("a", True, False), ("t", False, True)))[0]
    assert chat_repair.digest(chat_repair.repair(chat_repair.damage(table(spark, [], CONV)))).collect() == []
