"""Global row numbers and exact order statistics without a sort of all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.session import prepare

#: Share of the rows on either side of a rank that one round of selection leaves at most, about.
BRACKET = 1e-4
#: Bits of ``monotonically_increasing_id`` that count rows of a partition.
ROW_BITS = 33


def global_rank(df: DataFrame, key: str | Sequence[str], name: str, *ties: str, buckets: int | None = None) -> DataFrame:
    """Add ``name``, the row's place (from 0) in the order of the key, then of ``ties``.

    Rows are dealt by ranges of key and ties together, so that rows with one key spread
    too, and sorted within their partition; a count per partition shifts their places
    there. Only one count per partition reaches the driver. Null keys come first; rows
    equal in key and ties follow each other in any order, also dealt to several ranges.
    The result is settled, as places must not change when a partition is computed again.
    """
    prepare(df.sparkSession)
    order = [*([key] if isinstance(key, str) else key), *ties, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(buckets, *order) if buckets else rows.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).drop("_row").withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("_place", ROW_BITS), F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a partition
    shifts, total = [], 0
    for p, n in counts:
        shifts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row a partition
    return out.select(*df.columns, (F.col("_shift") + inside).alias(name))


def select_rank(rows: DataFrame, column: str, rank: int) -> float | None:
    """The value at a place (from 0) in the order of a numeric column; null if there is none.

    Each round takes two values that bracket the place from a quantile sketch, counts
    what lies below, at and between them, and goes on between them only. Sketches and
    counts combine where the rows are, so that nothing is dealt or sorted, however
    many rows are tied. A round leaves about two BRACKETs of its rows.
    """
    x = F.col(column)
    rows, left = rows.where(x.isNotNull() & ~F.isnan(x.cast("double"))).select(x.cast("double").alias("x")), rank
    n = rows.count()
    if not 0 <= rank < n:
        return None
    while True:
        at = (left + 0.5) / n
        low, high = rows.approxQuantile("x", [max(0.0, at - BRACKET), min(1.0, at + BRACKET)], BRACKET / 2)
        x, count = F.col("x"), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        s = rows.agg(count(x < low).alias("under"), count(x == low).alias("low"), count((x > low) & (x < high)).alias("between"), count((x == high) & (x > low)).alias("high")).first()
        if left < s["under"]:  # outside the bracket, if the sketch was off
            rows, n = rows.where(x < low), s["under"]
        elif left < (below := s["under"] + s["low"]):
            return low
        elif left < below + s["between"]:
            rows, left, n = rows.where((x > low) & (x < high)), left - below, s["between"]
        elif left < (below := below + s["between"] + s["high"]):
            return high
        else:
            rows, left, n = rows.where(x > high), left - below, n - below


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column by exact selection; null without any value."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).where(~F.isnan("x"))
    n = rows.count()
    if not n:
        return None
    low = select_rank(rows, "x", (n - 1) // 2)
    if n % 2:
        return low
    s = rows.agg(F.sum((F.col("x") <= low).cast("long")).alias("upto"), F.min(F.when(F.col("x") > low, F.col("x"))).alias("next")).first()
    return low if s["upto"] > n // 2 else (low + s["next"]) / 2
