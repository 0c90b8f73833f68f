"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models of URL characters, one for accepted
and one for rejected URLs, give each character a log-likelihood difference in
its context; a URL's mean difference is held against a calibrated threshold.
DataFrame functions only: model counts are grouped n-grams of all URLs that a rule
decides but the held-out quarter, from which the threshold comes; every distinct
n-gram of the URLs to score is looked up once, shortest contexts first, and their
characters are joined with that. Only n-grams with a large share of all characters
are broadcast. Work grows with the length of a URL. URLs are told apart by 128-bit
hashes of what the models read of them.

Cases: a null url, or one without ``://``, has an empty host and path, no rule and
no characters, so its mean difference is 0. With no URL decided by a rule, the
model is empty and every mean difference 0, which is allowed. Among rules that
fit, the one with the longest host and path wins, then the first in the list.
Repeated rows are judged alike; extra columns are not read. Long URLs are learned
from and scored whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import bounded, settle

#: (verdict, host, path, name): a rule fits its host and all subdomains if the path starts with its path.
RULES = [
    ("block", "com", "/en/", "com/en/"),
    ("allow", "example.com", "/en/7", "example.com/en/7"),
    ("allow", "net", "/de/", "net/de/"),
    ("block", "example.net", "/de/8", "example.net/de/8"),
    ("block", "org", "/es/", "org/es/"),
]
#: Longest n-gram: a character and the context before it.
ORDER = 5
#: An n-gram with more than one in so many of all characters is broadcast, which so many are at most: a shuffle would bring its rows together.
COMMON = 4096
#: Strength with which a context leans on the next shorter one; characters assumed in the alphabet.
LEAN, ALPHABET = 2.0, 128.0
START, END = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def ruled(pages: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Add host, path, rule and the rule's verdict (null where no rule fits)."""
    host, path = parts(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))  # stable: the first of equals wins
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start, name in reversed(order):
        fits = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit("." + at))) & F.startswith(F.col("path"), F.lit(start))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def characters(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row per character of ``text`` and its end: ``gram`` ends in it and has up to ORDER - 1 before it.

    The text is cut into characters once, as a position in a string is found only by walking from its start.
    """
    padded = F.split(F.concat(F.lit(START * (ORDER - 1)), F.col(text), F.lit(END)), "")
    spots = rows.where(F.length(text) > 0).select(*keep, padded.alias("_t"))
    grams = F.transform(F.slice("_t", F.lit(ORDER), F.size("_t") - (ORDER - 1)), lambda _, i: F.concat(*[F.get("_t", i + n) for n in range(ORDER)]))
    return spots.select(*keep, F.explode(grams).alias("gram"))


def model_text(url: str = "url") -> Column:
    """What the models read of a URL: all of it, digits as one character class."""
    return F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[0-9]", "0")


def suffix(gram: Column, n: int) -> Column:
    return F.substring(gram, ORDER - n + 1, n)


def fit(decided: DataFrame) -> DataFrame:
    """(gram, llr, lean): log-likelihood difference, accepted less rejected, of each n-gram's last character.

    ``decided`` has text and accepted (boolean). Each order is interpolated with
    the next shorter one: p(c | context) = (count + LEAN * p(c | shorter)) / (total + LEAN).
    An n-gram of ORDER - 1 characters at most, the empty one too, also stands as a
    context: ``lean`` is what a character that was never seen after it adds to its
    difference in the next shorter context, log((tr + LEAN) / (ta + LEAN)). One is
    null where the n-gram has no such role.
    """
    grams = settle(characters(decided, "text", "accepted").groupBy("gram", "accepted").agg(F.count("*").alias("n")))
    model, lower = None, None
    for n in range(1, ORDER + 1):
        side = lambda yes: F.sum(F.when(F.col("accepted") == yes, F.col("n")).otherwise(0))
        own = grams.groupBy(suffix(F.col("gram"), n).alias("gram")).agg(side(True).alias("a"), side(False).alias("r"))
        context = own.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        own = own.withColumn("context", F.substring("gram", 1, n - 1)).join(context, "context")
        if lower is None:
            own = own.withColumn("la", F.lit(1 / ALPHABET)).withColumn("lr", F.lit(1 / ALPHABET))
        else:
            own = own.withColumn("short", F.substring("gram", 2, n - 1)).join(lower.select(F.col("gram").alias("short"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "short")
        own = own.select("gram", ((F.col("a") + LEAN * F.col("la")) / (F.col("ta") + LEAN)).alias("pa"), ((F.col("r") + LEAN * F.col("lr")) / (F.col("tr") + LEAN)).alias("pr"))
        lower = settle(own)
        rows = lower.select("gram", F.log(F.col("pa") / F.col("pr")).alias("llr"), F.lit(None).cast("double").alias("lean"))
        leans = context.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("llr"), F.log((F.col("tr") + LEAN) / (F.col("ta") + LEAN)).alias("lean"))
        rows = rows.unionByName(leans)
        model = rows if model is None else model.unionByName(rows)
    return settle(model.groupBy("gram").agg(F.max("llr").alias("llr"), F.max("lean").alias("lean")))


def known(rows: DataFrame, model: DataFrame, text: str) -> DataFrame:
    """(gram, n, difference): every distinct n-gram of the texts' characters, how often it stands there, and its difference.

    A character takes its difference from the longest context it was seen in, and
    the lean of each longer context that was seen without it. A context, or a
    shorter n-gram, is that of no more n-grams than there are characters in the alphabet.
    """
    grams = settle(characters(rows, text).groupBy("gram").agg(F.count("*").alias("n")))
    asked = {ORDER: grams.select("gram")}
    for n in range(ORDER - 1, 0, -1):
        asked[n] = asked[n + 1].select(F.substring("gram", 2, n).alias("gram")).distinct()
    out = None
    for n in range(1, ORDER + 1):
        own = model.where(F.col("llr").isNotNull() & (F.length("gram") == n)).select(F.col("gram").alias("_own"), "llr")
        context = model.where(F.col("lean").isNotNull() & (F.length("gram") == n - 1)).select(F.col("gram").alias("_context"), "lean")
        looked = asked[n].join(own, F.col("gram") == F.col("_own"), "left").join(context, F.substring("gram", 1, n - 1) == F.col("_context"), "left")
        looked = looked.withColumn("_less", F.lit(0.0)) if out is None else looked.join(out.select(F.col("gram").alias("_short"), F.col("difference").alias("_less")), F.substring("gram", 2, n - 1) == F.col("_short"))
        out = looked.select("gram", F.coalesce(F.col("llr"), F.coalesce(F.col("lean"), F.lit(0.0)) + F.col("_less")).alias("difference"))
    return settle(grams.join(out, "gram").select("gram", "n", "difference"))


def means(rows: DataFrame, grams: DataFrame, text: str, key: str) -> DataFrame:
    """(key, mean difference) of every row with characters, whose n-grams are all in ``grams``; partial sums before the shuffle."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * COMMON > total
    chars = characters(rows, text, key).join(F.broadcast(grams.where(often).select("gram", "difference")), "gram", "left")  # fewer than COMMON
    seldom = chars.where(F.col("difference").isNull()).drop("difference").join(grams.where(~often).select("gram", "difference"), "gram")
    columns = [key, "difference"]
    chars = chars.where(F.col("difference").isNotNull()).select(columns).unionByName(seldom.select(columns))
    return chars.groupBy(key).agg((F.sum("difference") / F.count("*")).alias("difference"))


def scored(rows: DataFrame, model: DataFrame, text: str, key: str) -> DataFrame:
    """(key, mean difference) of every row with characters."""
    return means(rows, known(rows, model, text), text, key)


def calibrate(scores: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracy, in the middle of its best range.

    ``scores`` has difference and accepted; differences are counted in steps of 0.01.
    """
    step = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("difference"))), 2)
    counts = scores.groupBy(step.alias("at")).agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.sum((~F.col("accepted")).cast("int")).alias("r"))
    rows = sorted((r["at"], r["a"], r["r"]) for r in counts.collect())  # at most 4,001 steps
    yes, no = sum(a for _, a, _ in rows), sum(r for _, _, r in rows)
    if not yes or not no:
        return 0.0
    best, where, a_below, r_below = -1.0, (0.0, 0.0), 0, 0
    for k, (at, a, r) in enumerate(rows):
        a_below, r_below = a_below + a, r_below + r
        quality = (yes - a_below) / yes + r_below / no
        if quality > best:
            best, where = quality, (at, rows[k + 1][0] if k + 1 < len(rows) else at)
    return sum(where) / 2


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, difference of every row."""
    bounded(pages.sparkSession)
    rows = ruled(pages.select("page_id", "url"), rules).withColumn("_text", model_text())
    decided = rows.where(F.col("by_rule").isNotNull())
    fold = F.pmod(F.xxhash64("url"), F.lit(4))  # of a power of two: the same as of more of the hash
    taken = settle(decided.select(F.col("_text").alias("text"), (F.col("by_rule") == "allow").alias("accepted"), fold.alias("fold"), F.col("url").alias("key")))
    model = fit(taken.where("fold <> 3"))
    held = taken.where("fold = 3").select("key", "text", "accepted").distinct()
    # rows that a rule decides, or without characters, need no score and no join
    plain = F.col("by_rule").isNotNull() | (F.length("_text") == 0)
    asked = rows.where(~plain).withColumn("_key", F.struct(F.xxhash64("_text"), F.xxhash64(F.lit(1), F.col("_text"))))
    texts = asked.groupBy("_key").agg(F.first("_text").alias("_text"))  # equal keys have equal texts
    grams = known(held.select("text").unionByName(texts.select(F.col("_text").alias("text"))), model, "text")
    threshold = calibrate(means(held, grams, "text", "key").join(held, "key"))
    judged = asked.join(means(texts, grams, "_text", "_key"), "_key", "left")
    columns = ["page_id", "host", "path", "rule", "by_rule", "difference"]
    judged = judged.select(columns).unionByName(rows.where(plain).withColumn("difference", F.when(F.col("by_rule").isNull(), 0.0)).select(columns))
    by_model = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "difference")
