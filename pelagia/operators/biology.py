"""Bins, counts, proportions, weights and population estimates, all in long form.

A labelled cube is a DataFrame with one row per cell: key columns and a value.
Totals come from an aggregate joined back, so that a stratum that most rows
have is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(mids: Sequence[float]) -> list[float]:
    """Edges of bins around their middles; the width is the mean half difference."""
    half = sum(b - a for a, b in zip(mids, mids[1:])) / max(1, len(mids) - 1) / 2
    return [mids[0] - half, *(m + half for m in mids)]


def bin_table(spark, mids: Sequence[float]) -> DataFrame:
    """(bin, left, right) of every right-closed bin."""
    e = edges(mids)
    return spark.createDataFrame([(float(m), a, b) for m, a, b in zip(mids, e, e[1:])], "bin double, left double, right double")


def bin_of(x: Column, mids: Sequence[float]) -> Column:
    """The middle of the right-closed bin that holds a value; null outside all bins."""
    e, m = edges(mids), [float(v) for v in mids]
    steps = {round(b - a, 9) for a, b in zip(m, m[1:])}
    if len(steps) <= 1:  # even bins: arithmetic, whatever their number
        width = e[1] - e[0]
        k = F.ceil((x - F.lit(e[0])) / F.lit(width))
        return F.when((x > e[0]) & (x <= e[-1]), F.lit(m[0]) + (k - 1) * F.lit(width)).cast("double")
    out = F.lit(None).cast("double")
    for mid, a, b in reversed(list(zip(m, e, e[1:]))):
        out = F.when((x > a) & (x <= b), mid).otherwise(out)
    return out


def binify(df: DataFrame, mids: Sequence[float], column: str) -> DataFrame:
    """Add ``<column>_bin``; a frame without the column stays as it is."""
    return df.withColumn(f"{column}_bin", bin_of(F.col(column), mids)) if column in df.columns else df


def binned_counts(df: DataFrame, keys: Sequence[str], count: str | None = None) -> DataFrame:
    """Rows, or the sum of ``count``, per combination of the keys."""
    return df.groupBy(*keys).agg((F.count("*") if count is None else F.sum(count)).cast("double").alias("count"))


def quantize_lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of fish per key and length."""
    how = F.sum("length_count") if "length_count" in df.columns else F.count("*")
    return df.groupBy(*keys, "length").agg(how.cast("long").alias("length_count"))


def number_proportions(counts: Mapping[str, DataFrame], stratum: str, exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Each source's counts as shares of its stratum's total over all sources, with a ``source`` column.

    Columns that a source lacks are null there.
    """
    whole = None
    for name, df in counts.items():
        for c, values in (exclude or {}).items():
            if c in df.columns:
                df = df.where(~F.coalesce(F.col(c).isin(list(values)), F.lit(False)))
        df = df.withColumn("source", F.lit(name))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    total = whole.groupBy(stratum).agg(F.sum("count").alias("_total"))
    return whole.join(total, stratum).withColumn("proportion", F.try_divide("count", "_total")).drop("_total")


def length_weight_regression(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of log10 weight on log10 length, per key."""
    x, y = F.log10("length"), F.log10("weight")
    rows = df.where("length > 0 AND weight > 0")
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def length_binned_weights(df: DataFrame, mids: Sequence[float], coefficients: DataFrame, keys: Sequence[str] = (), minimum: int = 0, impute: bool = True) -> DataFrame:
    """Mean weight per length bin (and key); modelled from the regression where fish are too few.

    ``df`` has length and weight, ``coefficients`` slope and intercept per key.
    """
    spine = coefficients.withColumn("length_bin", F.explode(F.array(*[F.lit(float(m)) for m in mids])))
    modelled = F.pow(F.lit(10.0), F.col("intercept")) * F.pow("length_bin", F.col("slope"))
    seen = binify(df, mids, "length").where("length_bin IS NOT NULL").groupBy(*keys, "length_bin").agg(F.count("weight").alias("n"), F.avg("weight").alias("observed"))
    out = spine.withColumn("modelled", modelled).join(seen, [*keys, "length_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = (F.col("n") < minimum) if minimum > 0 else F.col("n") == 0
    fitted = F.when(few, F.col("modelled")).otherwise(F.col("observed")) if impute else F.coalesce("observed", F.lit(0.0))
    return out.select(*keys, "length_bin", fitted.alias("weight_fitted"))


def interpolators(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key, the sorted points (x, mean y) of a piecewise-linear curve; keys with one point have none."""
    means = df.groupBy(*keys, x).agg(F.avg(y).alias("_y")).where(F.col("_y").isNotNull())
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("_y").alias("y")))).alias("curve")).where(F.size("curve") > 1)


def at_curve(x: str, curve: str = "curve") -> Column:
    """Value of a sorted curve at x, straight between points and level outside them."""
    # the last point at or before x, by halving steps
    last = f"aggregate(reverse(sequence(0, cast(log2(size({curve})) AS int))), 0, (k, b) -> k + if(get({curve}, k + shiftleft(1, b)).x <= {x}, shiftleft(1, b), 0))"
    between = f"transform(array({last}), k -> {curve}[k].y + ({x} - {curve}[k].x) * ({curve}[k + 1].y - {curve}[k].y) / ({curve}[k + 1].x - {curve}[k].x))[0]"
    return F.expr(
        f"CASE WHEN {x} IS NULL OR {curve} IS NULL THEN NULL WHEN {x} <= {curve}[0].x THEN {curve}[0].y WHEN {x} >= element_at({curve}, -1).x THEN element_at({curve}, -1).y ELSE {between} END"
    )


def combined(df: DataFrame, keys: Sequence[str], length: str = "length", count: str = "length_count") -> DataFrame:
    """Rows of equal keys and length as one with the sum of their counts, for weights that are only summed up later."""
    return df.groupBy(*keys, length).agg(F.sum(count).alias(count))


def interpolated_weight(df: DataFrame, curves: DataFrame, keys: Sequence[str], length: str = "length", count: str = "length_count") -> DataFrame:
    """Add ``weight``: the curve's weight at the row's length times its count."""
    rows = df.join(curves, list(keys), "left") if keys else df.join(curves.limit(1), F.lit(True), "left")
    return rows.withColumn("weight", at_curve(length) * F.col(count)).drop("curve")


def binned_weights(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total weight per key; null weights count as none."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


def stratum_weights(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


def adjusted_proportions(proportions: DataFrame, group: str, stratum: str, first: str, key: str) -> DataFrame:
    """Shares of every source for each value of ``key``, with the first source's complement.

    ``proportions`` has source, stratum, key, aggregate (the source's share of the
    stratum) and share (the key's share of the stratum in that source). Other
    sources: aggregate / (aggregate + first share); the first: its share / (share
    + the others' adjusted total). A single source keeps its shares as they are.
    """
    rows = proportions.select(stratum, key, group, "aggregate", "share")
    head = rows.where(F.col(group) == first).select(stratum, key, F.col("share").alias("_first"))
    others = rows.where(F.col(group) != first).join(head, [stratum, key], "left")
    others = others.withColumn("adjusted", F.try_divide(F.col("aggregate"), F.col("aggregate") + F.coalesce("_first", F.lit(0.0))))
    total = others.groupBy(stratum, key).agg(F.sum("adjusted").alias("_others"))
    firsts = head.join(total, [stratum, key], "left").withColumn("adjusted", F.try_divide(F.col("_first"), F.col("_first") + F.coalesce("_others", F.lit(0.0))))
    alone = rows.agg((F.count_if(F.col(group) != first) == 0).alias("_alone"))  # one row
    firsts = firsts.crossJoin(F.broadcast(alone)).withColumn("adjusted", F.when(F.col("_alone"), F.col("_first")).otherwise(F.col("adjusted")))
    return others.select(stratum, key, group, "adjusted").unionByName(firsts.select(stratum, key, F.lit(first).alias(group), "adjusted"))


def within_proportions(proportions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Proportions as shares of their group's total."""
    total = proportions.groupBy(*keys).agg(F.sum("proportion").alias("_t"))
    return proportions.join(total, list(keys)).withColumn("within", F.try_divide("proportion", "_t")).drop("_t")


def average_weight(proportions: DataFrame, weights: DataFrame, stratum: str, sex: str = "sex", group: str = "source") -> DataFrame:
    """Mean weight of a fish per stratum, for every sex and for ``all``.

    ``proportions`` has source, stratum, sex, length_bin, proportion; ``weights``
    sex (with ``all``), length_bin, weight_fitted. Sources weigh by their share.
    """
    by_all = weights.where(F.col(sex) == "all").select("length_bin", F.col("weight_fitted").alias("w_all"))
    whole = proportions.join(by_all, "length_bin").groupBy(stratum).agg(F.try_divide(F.sum(F.col("proportion") * F.col("w_all")), F.sum("proportion")).alias("average_weight")).select(stratum, F.lit("all").alias(sex), "average_weight")
    own = proportions.join(weights, ["length_bin", sex]).groupBy(stratum, sex).agg(F.try_divide(F.sum(F.col("proportion") * F.col("weight_fitted")), F.sum("proportion")).alias("average_weight"))
    return whole.unionByName(own)


def weight_proportions(weights: DataFrame, catches: DataFrame, stratum: str, lengths: DataFrame | None = None) -> DataFrame:
    """Weights as shares of their stratum's catch.

    With ``lengths`` the catch counts only hauls that have length samples, and the
    weights' own total is added to it. Strata without a total give null.
    """
    if lengths is not None:
        catches = catches.join(lengths.select("haul_num").distinct(), "haul_num", "left_semi")
    total = catches.groupBy(stratum).agg(F.sum("weight").alias("_catch"))
    if lengths is not None:
        own = weights.groupBy(stratum).agg(F.sum("weight").alias("_own"))
        total = total.join(own, stratum, "full").select(stratum, (F.coalesce("_catch", F.lit(0.0)) + F.coalesce("_own", F.lit(0.0))).alias("_catch"))
    return weights.join(total, stratum, "left").withColumn("proportion", F.try_divide("weight", "_catch")).drop("_catch")


def fitted_proportions_combined(numbers: DataFrame, weights: DataFrame, stratum: str, keys: Sequence[str]) -> DataFrame:
    """Number shares times fitted weight, normalised within the stratum; 0 where the stratum has nothing."""
    rows = within_proportions(numbers, [stratum]).join(weights, list(keys)).withColumn("_v", F.col("within") * F.col("weight_fitted"))
    total = rows.groupBy(stratum).agg(F.sum("_v").alias("_t"))
    return rows.join(total, stratum).withColumn("proportion", F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(0.0)).select(stratum, *keys, "proportion")


def fitted_proportions(weights: DataFrame, aged: DataFrame, numbers: DataFrame, fitted: DataFrame, stratum: str, sex: str = "sex") -> DataFrame:
    """Unaged weight shares: what the aged leave, by length and by sex.

    (1 - sum of aged shares) * (length's number share * weight, normalised) * (sex's share of weight).
    """
    left = aged.groupBy(stratum).agg((1 - F.sum("proportion")).alias("_left"))
    by_length = fitted_proportions_combined(numbers.groupBy(stratum, "length_bin").agg(F.sum("proportion").alias("proportion")), fitted, stratum, ["length_bin"]).withColumnRenamed("proportion", "_len")
    by_sex = weights.groupBy(stratum, sex).agg(F.sum("weight").alias("_w"))
    total = by_sex.groupBy(stratum).agg(F.sum("_w").alias("_t"))
    by_sex = by_sex.join(total, stratum).select(stratum, sex, F.try_divide("_w", "_t").alias("_sex"))
    rows = by_length.join(by_sex, stratum).join(left, stratum, "left")
    return rows.select(stratum, sex, "length_bin", (F.coalesce("_left", F.lit(1.0)) * F.col("_len") * F.col("_sex")).alias("proportion"))


def slice_share(df: DataFrame, stratum: str, value: Column, include: Column) -> DataFrame:
    """Share of each stratum's value that lies in a slice."""
    return df.groupBy(stratum).agg(F.try_divide(F.coalesce(F.sum(F.when(include, value)), F.lit(0.0)), F.sum(value)).alias("share"))


def sigma(length: Column, slope: float = 20.0, intercept: float = -68.0) -> Column:
    """Backscattering cross-section of a length by the target-strength regression."""
    return F.pow(F.lit(10.0), (slope * F.log10(length) + intercept) / 10.0)


def nasc_share(numbers: DataFrame, stratum: str, include: Column, slope: float = 20.0, intercept: float = -68.0) -> DataFrame:
    """Share of each stratum's backscatter that a slice of the fish gives."""
    return slice_share(numbers, stratum, F.col("proportion") * sigma(F.col("length_bin"), slope, intercept), include)


def weight_share(weights: DataFrame, stratum: str, include: Column, numbers: DataFrame | None = None, number_include: Column | None = None, minimum_length: float | None = None, threshold: float = 1e-10) -> DataFrame:
    """``slice_share`` of weight, 0 where the slice's number or weight share is not above the threshold."""
    out = slice_share(weights, stratum, F.col("proportion"), include)
    if numbers is not None:
        rows = numbers if minimum_length is None else numbers.where(F.col("length_bin") >= minimum_length)
        out = out.join(slice_share(rows, stratum, F.col("proportion"), include if number_include is None else number_include).withColumnRenamed("share", "_n"), stratum, "left")
        out = out.withColumn("share", F.when(F.coalesce("_n", F.lit(0.0)) <= threshold, 0.0).otherwise(F.col("share"))).drop("_n")
    return out.withColumn("share", F.when(F.col("share") <= threshold, 0.0).otherwise(F.col("share")))


def abundance(df: DataFrame, shares: DataFrame | None, stratum: str, category: str = "sex", exclude: Sequence = ()) -> DataFrame:
    """Density times area, and both per category by the stratum's number shares, in long form.

    ``df`` has area_interval and number_density; rows of category ``all`` hold the
    whole. Strata without a share give 0.
    """
    whole = df.withColumn("abundance", F.col("area_interval") * F.col("number_density"))
    out = whole.withColumn(category, F.lit("all"))
    if shares is None:
        return out
    p = shares.where(~F.col(category).isin(list(exclude))) if exclude else shares
    p = p.groupBy(stratum, category).agg(F.sum("proportion").alias("_p"))
    # every category of the shares, in each stratum: a few values
    each = whole.crossJoin(F.broadcast(p.select(category).distinct())).join(p, [stratum, category], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    each = each.withColumn("abundance", F.col("abundance") * F.col("_p")).withColumn("number_density", F.col("number_density") * F.col("_p")).drop("_p")
    return out.unionByName(each.select(*out.columns))


def biomass(df: DataFrame, weights: DataFrame, keys: Sequence[str], stratum: str, category: str = "sex", value: str = "abundance", name: str = "biomass") -> DataFrame:
    """Per row key: each category by its mean weight, the rest of the whole by the mean weight of all.

    ``df`` is long as ``abundance`` gives it, ``weights`` has stratum, category
    (with ``all``) and average_weight. Without categories the whole has one weight.
    """
    rows = df.join(weights, [stratum, category], "left")
    own = F.sum(F.when(F.col(category) != "all", F.col(value) * F.col("average_weight")))
    known = F.sum(F.when(F.col(category) != "all", F.col(value)))
    whole = F.max(F.when(F.col(category) == "all", F.col(value)))
    mean = F.max(F.when(F.col(category) == "all", F.col("average_weight")))
    return rows.groupBy(*keys).agg((F.coalesce(own, F.lit(0.0)) + (whole - F.coalesce(known, F.lit(0.0))) * mean).alias(name))
