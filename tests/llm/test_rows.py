"""Chat formatting, the URL filter and the pipeline on small inputs."""

import hashlib
import math
from collections import defaultdict

from pelagia.llm import chat, urls
from pelagia.llm.queries import TRICKY, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", TRICKY), (2, 0, "assistant", None), (2, 1, None, "\\l\\\\<s>"), (3, 0, "tool", "[ROLE]x[TEXT]"), (3, 1, "assistant", ""), (3, 2, "assistant", "\n\\"), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role or "", text or ""))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns))), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss)), c


URLS = [None, "", "nope", "http://A.example.COM/en/7x?q#f", "https://example.com/en/6", "http://xcom/en/", "http://com/en/", "ftp://a.net/de/1", "http://example.net/de/8", "http://q.example.net/de/9", "http://w.org/es/", "http://w.org/fr/", "http://h?x", "://", "a://b://c/d", "http://Ünï.org/es/a b"]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(URLS)], "page_id long, url string, host string, difference double")
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
            host, _, tail = rest.partition("/")
            path = "/" + tail if "/" in rest else ""
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max(((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[1]), u
        assert r["verdict"] == fit[2] if fit else r["verdict"] in ("allow", "block")


def test_url_differences_are_those_of_the_smoothed_models(spark):
    seen = [("abcab", True)] * 9 + [("abd", False), ("bcd", False), ("abxab", True), ("ca", False)]
    asked = ["abcab", "abz", "zabq", "q", "bcdx", "cabdab", "zz"]

    def grams(t):
        t = urls.START * (urls.ORDER - 1) + t + urls.END
        return [t[k : k + urls.ORDER] for k in range(len(t) - urls.ORDER + 1)]

    counts = [defaultdict(int), defaultdict(int)]  # of every n-gram, by class
    for t, yes in seen:
        for g in grams(t):
            for n in range(1, urls.ORDER + 1):
                counts[yes][g[-n:]] += 1

    def p(yes, gram):
        """The interpolated probability of a gram's last character."""
        if not gram:
            return 1 / urls.ALPHABET
        total = sum(n for g, n in counts[yes].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (counts[yes][gram] + urls.LEAN * p(yes, gram[1:])) / (total + urls.LEAN)

    model = urls.fit(spark.createDataFrame(seen, "text string, accepted boolean"))
    got = {r["t"]: r["difference"] for r in urls.scored(spark.createDataFrame([(t,) for t in asked], "t string"), model, "t", "t").collect()}
    for t in asked:
        want = sum(math.log(p(True, g) / p(False, g)) for g in grams(t)) / (len(t) + 1)
        assert abs(got[t] - want) < 1e-9, (t, got[t], want)


def test_pipeline_keeps_only_input_documents(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    known = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= known


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 14)]
