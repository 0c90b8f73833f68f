"""Line dedup: a line that several documents hold stays in the first of them only.

DataFrame functions only. Every line of at least MIN_CHARS code points becomes a
128-bit hash of its key with its document and position. Hashes are dealt by range
and sorted by (hash, document, position), so that a window streams each key's
lines from its first occurrence on; what follows in other documents is dropped.
Keys with more than one in HOT of all lines, which the frequent-items sketch
finds, would crowd one range: their first document comes from a grouped minimum
that combines before its shuffle (at most HOT keys, broadcast back), and their
lines aren't dealt at all. Result is a compressed bitmap for each document that
lost lines, never text.

A bitmap covers lines up to the last one dropped; all later ones stay. Its first
byte is its form, whichever is shorter: 0, then a bit a line, 1 for kept, most
significant first; or 1, then runs of dropped lines, each a start and a length of
four bytes, big-endian.

Cases: a null or empty text is one empty line. A null doc_id neither loses lines
nor takes any from others. Rows with one doc_id count as one document; each gets
the bitmap of its own text. No line is dropped from the document that holds it
first, however often it repeats there. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import settle
from pelagia.session import prepare

#: Shortest key, in code points, that can be a repeat.
MIN_CHARS = 10
#: A key with more than one in HOT of all lines isn't dealt by range; bounds those keys.
HOT = 4096
#: Keys that the frequent-items sketch follows; its error is about 3.5 in SKETCH of all lines.
SKETCH = 65536
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty have one, which is empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line stripped of ASCII white space, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (hash of the text, tells apart rows of one doc_id), pos, h1, h2 of every line that can be a repeat."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def frequent(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """Column h1 of at most ``hot`` hashes: all that more than one in ``hot`` lines have are among them."""
    top = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {hot}, {max(hot, SKETCH)})").alias("top"))
    return top.select("n", F.explode("top").alias("t")).where((F.col("t.count") > 1) & (F.col("t.count") * hot > F.col("n"))).select(F.col("t.item").alias("h1"))


def repeats(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, row, pos of every line whose key a smaller doc_id holds too."""
    often = settle(frequent(lines, hot))
    first = lines.join(F.broadcast(often), "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    crowded = lines.join(F.broadcast(first), ["h1", "h2"])  # both sides of the union broadcast at most ``hot`` hashes
    dealt = lines.join(F.broadcast(often), "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    streamed = dealt.withColumn("first", F.first("doc_id").over(Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    columns = ["doc_id", "row", "pos", "first"]
    return streamed.select(columns).unionByName(crowded.select(columns)).where("doc_id > first").drop("first")


def runs_of(dropped: Column) -> tuple[Column, Column]:
    """First and last positions of the runs of a sorted array of positions."""
    n = F.size(dropped)
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    stops = F.filter(dropped, lambda p, i: (i == n - 1) | (F.get(dropped, i + 1) != p + 1))
    return starts, stops


def bitmap(starts: Column, stops: Column) -> Column:
    """The shorter form of the bitmap whose dropped runs have these first and last positions."""
    wide = lambda x: F.lpad(F.hex(x), 8, "0")
    runs = F.transform(starts, lambda s, i: F.concat(wide(s), wide(F.get(stops, i) - s + 1)))
    marks = F.transform(starts, lambda s, i: F.concat(F.repeat(F.lit("1"), s - F.when(i == 0, 0).otherwise(F.get(stops, i - 1) + 1)), F.repeat(F.lit("0"), F.get(stops, i) - s + 1)))
    n_bytes = F.floor((F.get(stops, F.size(stops) - 1) + 8) / 8).cast("int")
    bits = F.rpad(F.array_join(marks, ""), n_bytes * 8, F.lit("1")).cast("binary")
    octet = lambda b, j: F.lpad(F.conv(F.substring(b, j * 8 + 1, F.lit(8)).cast("string"), 2, 16), 2, "0")
    octets = lambda b: F.transform(F.sequence(F.lit(0), n_bytes - 1), lambda j: octet(b, j))
    plain = F.get(F.transform(F.array(bits), octets), F.lit(0))  # a lambda's argument is computed once, not for every byte
    short = F.size(starts) * 8 < n_bytes
    return F.unhex(F.when(short, F.concat(F.lit("01"), F.array_join(runs, ""))).otherwise(F.concat(F.lit("00"), F.array_join(plain, ""))))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """doc_id, row, n_dropped, keep (bitmap) of every document that loses lines; ``row`` is xxhash64 of its text."""
    prepare(docs.sparkSession)
    lines = settle(line_hashes(docs, min_chars))
    gone = repeats(lines, hot).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    starts, stops = runs_of(F.col("gone"))
    runs = gone.select("doc_id", "row", F.size("gone").cast("long").alias("n_dropped"), starts.alias("starts"), stops.alias("stops"))
    return runs.select("doc_id", "row", "n_dropped", bitmap(F.col("starts"), F.col("stops")).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; a null bitmap keeps all."""
    number = lambda at, n: F.conv(F.hex(F.substring(keep, at, F.lit(n))), 16, 10).cast("int")
    n, runs = F.octet_length(keep) - 1, ((F.octet_length(keep) - 1) / 8).cast("int")
    bit = lambda i: F.substring(F.lpad(F.bin(number((i / 8).cast("int") + 2, 1)), 8, "0"), i % 8 + 1, F.lit(1)) == "1"
    by_bits = F.filter(lines, lambda _, i: (i >= n * 8) | bit(i))
    start = lambda i: F.when(i == 0, 0).otherwise(number(i * 8 - 6, 4) + number(i * 8 - 2, 4))
    stop = lambda i: F.when(i == runs, F.size(lines)).otherwise(number(i * 8 + 2, 4))
    by_runs = F.flatten(F.transform(F.sequence(F.lit(0), runs), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))
    return F.when(keep.isNull(), lines).when(number(F.lit(1), 1) == 1, by_runs).otherwise(by_bits)


def deduplicate(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the remaining text) of every document, by its bitmap."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(bitmaps, ["doc_id", "row"], "left")
    lines = texts.select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.array_join(kept_lines(F.col("lines"), F.col("keep")), "\n").alias("kept"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return deduplicate(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
