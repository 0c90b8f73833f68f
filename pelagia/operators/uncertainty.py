"""Stratified transect statistics, bootstrap replicates and confidence intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.special import normal_cdf, normal_ppf, t_ppf
from pelagia.operators.cleaning import round_half_up

EARTH = (6378137.0, 1 / 298.257223563)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def geodesic_nmi(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Distance on the WGS-84 ellipsoid in nautical miles (Vincenty's inverse series), as a column.

    Every round binds its values by name, so the expression grows with the rounds
    and not with their power. Equal points are 0 apart; a null position gives null.
    """
    a, f = EARTH
    b = a * (1 - f)

    def sphere(lam: Column, g: Column) -> Column:
        """sin and cos of the arc, the arc, cos squared of its azimuth, cos of twice the midpoint."""
        sl, cl = F.sin(lam), F.cos(lam)
        sin_s = F.sqrt((g["c2"] * sl) ** 2 + (g["c1"] * g["s2"] - g["s1"] * g["c2"] * cl) ** 2)
        arc = F.struct(sin_s.alias("sin"), (g["s1"] * g["s2"] + g["c1"] * g["c2"] * cl).alias("cos"))

        def azimuth(v: Column) -> Column:
            sin_a = F.coalesce(F.try_divide(g["c1"] * g["c2"] * sl, v["sin"]), F.lit(0.0))
            return F.struct(v["sin"].alias("sin"), v["cos"].alias("cos"), F.atan2(v["sin"], v["cos"]).alias("arc"), sin_a.alias("sin_a"), (1 - sin_a * sin_a).alias("cos2a"))

        def middle(v: Column) -> Column:
            mid = v["cos"] - F.coalesce(F.try_divide(2 * g["s1"] * g["s2"], v["cos2a"]), F.lit(0.0))
            return F.struct(*[v[k].alias(k) for k in ("sin", "cos", "arc", "sin_a", "cos2a")], mid.alias("mid"))

        return bound(bound(arc, azimuth), middle)

    def step(lam: Column, g: Column) -> Column:
        def moved(v: Column) -> Column:
            c = f / 16 * v["cos2a"] * (4 + f * (4 - 3 * v["cos2a"]))
            return g["gap"] + (1 - c) * f * v["sin_a"] * (v["arc"] + c * v["sin"] * (v["mid"] + c * v["cos"] * (2 * v["mid"] * v["mid"] - 1)))

        return bound(sphere(lam, g), moved)

    def length(v: Column) -> Column:
        u = v["cos2a"] * ((a * a - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m, s = v["mid"], v["sin"]
        d = small * s * (m + small / 4 * (v["cos"] * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
        return F.when(s == 0, 0.0).otherwise(b * big * (v["arc"] - d) / 1852.0)

    def solve(g: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), g["gap"], lambda lam, _: step(lam, g))
        return bound(sphere(lam, g), length)

    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    given = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("gap"))
    return bound(given, solve)


def virtual_transects(mesh: DataFrame, per_degree: int, variable: str, strata: Callable[[Column], Column] | None = None) -> DataFrame:
    """Transects of a mesh by rounded latitude: latitude, length across, area, sum of the variable.

    A transect lies on its rounded latitude. Its area is its length times the mean
    spacing of the latitudes, half of that for the first and the last; with a single
    transect there is no spacing and the area is null. ``strata`` maps the latitude
    to a stratum.
    """
    lat = round_half_up(F.col("latitude") * per_degree + 0.5) / per_degree
    g = mesh.where(F.col("latitude").isNotNull()).groupBy(lat.alias("latitude")).agg(F.min("longitude").alias("x0"), F.max("longitude").alias("x1"), F.sum(variable).alias(variable))
    spans = g.agg(F.min("latitude").alias("y0"), F.max("latitude").alias("y1"), F.count("*").alias("n"))
    out = g.crossJoin(F.broadcast(spans))  # one row
    spacing = F.try_divide(F.col("y1") - F.col("y0"), F.col("n") - 1) * 60.0
    edge = (F.col("latitude") == F.col("y0")) | (F.col("latitude") == F.col("y1"))
    out = out.withColumn("distance", geodesic_nmi(F.col("x0"), F.col("latitude"), F.col("x1"), F.col("latitude")))
    out = out.withColumn("area", F.col("distance") * spacing * F.when(edge, 0.5).otherwise(1.0))
    # the number of latitudes is bounded by the rounding, whatever the mesh
    out = out.withColumn("transect_num", F.row_number().over(Window.orderBy("latitude"))).select("transect_num", "latitude", "distance", "area", variable)
    return out if strata is None else out.withColumn("stratum", strata(F.col("latitude")))


def transect_statistics(df: DataFrame, stratum: str, variable: str, distance: Column, area: str) -> DataFrame:
    """Per stratum and transect: the variable's sum, distance, area, and value per distance and per area."""
    out = df.groupBy(stratum, "transect_num").agg(F.sum(variable).alias(variable), distance.alias("distance"), F.sum(area).alias("area"))
    return out.withColumn("per_distance", F.try_divide(variable, "distance")).withColumn("per_area", F.try_divide(variable, "area"))


def strata_statistics(transects: DataFrame, stratum: str, variable: str, share: float) -> DataFrame:
    """Per stratum: transects, those to sample, sums, and value per area and per distance."""
    out = transects.groupBy(stratum).agg(F.count(variable).alias("n_transects"), F.sum(variable).alias(variable), F.sum("distance").alias("distance"), F.sum("area").alias("area"))
    out = out.withColumn("n_sampled", F.greatest(round_half_up(F.col("n_transects") * share).cast("long"), F.lit(1)))
    return out.withColumn("density", F.try_divide(variable, "area")).withColumn("distance_density", F.try_divide(variable, "distance"))


def jolly_hampton(transects: DataFrame, keys: Sequence[str], stratum: str, variable: str) -> DataFrame:
    """Per stratum (and replicate): transects, distance, area, total, and the distance-weighted mean and its variance.

    The mean weighs each transect's sum by its distance; the variance is that of the
    values per distance about it. Transects without distance have no weight.
    """
    by = [*keys, stratum]
    m = transects.groupBy(*by).agg(F.count("*").alias("n"), F.sum("distance").alias("d"), F.coalesce(F.try_divide(F.sum(F.col(variable) * F.col("distance")), F.sum("distance")), F.lit(0.0)).alias("mean"), F.sum("area").alias("area"), F.sum(variable).alias("total"))
    rows = transects.drop("area").join(m, by)
    weight = F.try_divide(F.col("distance") * F.col("n"), F.col("d"))
    part = F.coalesce((weight * (F.try_divide(F.col(variable), F.col("distance")) - F.col("mean"))) ** 2, F.lit(0.0))
    dof = F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)).otherwise(1)
    return rows.groupBy(*by, "n", "d", "mean", "area", "total").agg(F.sum(part).alias("_s")).withColumn("variance", F.col("_s") / dof).drop("_s").withColumnRenamed("d", "distance")


def survey_cv(strata: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation over strata weighted by their whole area."""
    return strata.groupBy(*keys).agg(F.try_divide(F.sqrt(F.sum(F.col("variance") * F.col("area") ** 2)), F.sum(F.col("mean") * F.col("area"))).alias("cv"))


def replicate_estimates(replicates: DataFrame, strata: DataFrame, stratum: str, variable: str) -> DataFrame:
    """Per replicate and stratum: estimates scaled from the sampled transects to the stratum.

    total is divided by the sampled share; density is that total per area of the
    whole stratum; distance and sampled_area are sums over the sample; area is the
    stratum's. mean and variance are distance-weighted (see ``jolly_hampton``).
    """
    j = jolly_hampton(replicates, ["replicate"], stratum, variable).withColumnRenamed("area", "sampled_area")
    whole = strata.select(stratum, F.col("area"), (F.col("n_sampled") / F.col("n_transects")).alias("_share"))
    out = j.join(whole, stratum).withColumn("total", F.try_divide("total", "_share")).drop("_share")
    return out.withColumn("density", F.try_divide("total", "area"))


def survey_estimates(replicates: DataFrame, keys: Sequence[str] = ("replicate",)) -> DataFrame:
    """Over all strata: total, density weighted by area, and CV."""
    area = F.sum("area")
    cv = F.try_divide(F.sqrt(F.sum(F.col("variance") * F.col("area") ** 2)), F.sum(F.col("mean") * F.col("area")))
    return replicates.groupBy(*keys).agg(F.sum("total").alias("total"), F.try_divide(F.sum(F.col("density") * F.col("area")), area).alias("density"), cv.alias("cv"))


def summarize(transects: DataFrame, stratum: str, variable: str, share: float = 0.75, replicates: int = 1000, seed: int = 0, method: str = "t-jackknife", level: float = 0.95, statistics: Sequence[str] = ("total", "density", "cv")) -> DataFrame:
    """(scope, statistic, low, mean, high, bias): intervals of totals and densities by stratum, and of the survey with its CV.

    scope is the stratum, or ``survey``. The population values that bias is held
    against are the statistics of all transects.
    """
    strata = strata_statistics(transects, stratum, variable, share)
    drawn = bootstrap(transects.select(stratum, "transect_num", variable, "distance", "area"), strata, stratum, replicates, seed)
    each = replicate_estimates(drawn, strata, stratum, variable)
    unpivot = lambda df, scope, names: df.select(scope.alias("scope"), F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("x")) for n in names])).alias("v")).select(F.to_json(F.struct("scope", "v.statistic")).alias("name"), "v.x")
    all_, two = survey_estimates(each), [n for n in statistics if n != "cv"]
    samples = unpivot(each, F.col(stratum).cast("string"), two).unionByName(unpivot(all_, F.lit("survey"), statistics))
    own = jolly_hampton(transects.select(stratum, "transect_num", variable, "distance", "area"), [], stratum, variable).withColumn("density", F.try_divide("total", "area"))
    known = unpivot(own, F.col(stratum).cast("string"), two).unionByName(unpivot(survey_estimates(own, []), F.lit("survey"), statistics))
    population = {r["name"]: r["x"] for r in known.collect()}  # two rows per stratum and three
    out = confidence_interval(samples, "name", "x", population, method, level)
    of = lambda k: F.get_json_object("name", f"$.{k}").alias(k)
    return out.select(of("scope"), of("statistic"), "low", "mean", "high", "bias")


def bootstrap(transects: DataFrame, strata: DataFrame, stratum: str, replicates: int, seed: int = 0) -> DataFrame:
    """Replicates that sample transects of each stratum without replacement.

    The order of sampling is that of md5(seed-replicate-stratum-transect), the same
    in any engine and for any partitioning; ``strata`` has n_sampled.
    """
    rows = transects.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(stratum).cast("string"), F.col("transect_num").cast("string")))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "replicate").orderBy(draw, "transect_num")))
    return ranked.join(strata.select(stratum, "n_sampled"), stratum).where("_k <= n_sampled").drop("_k", "n_sampled")


CI_METHODS = ("bc", "bca", "empirical", "normal", "percentile", "t", "t-jackknife")


def confidence_interval(samples: DataFrame, name: str, value: str, population: dict[str, float], method: str = "t-jackknife", level: float = 0.95) -> DataFrame:
    """(name, low, mean, high, bias) of every named statistic from its bootstrap values.

    Leave-one-out terms come in closed form from sums, so nothing is quadratic.
    Fewer than three values give null limits for t-jackknife; a population value
    outside all samples is an error for bc and bca.
    """
    if method not in CI_METHODS:
        raise ValueError(f"ci_method '{method}' is not one of {', '.join(CI_METHODS)}")
    qs = ((1 - level) / 2, (1 + level) / 2)
    x = F.col(value)
    pop = F.create_map(*[F.lit(v) for kv in population.items() for v in kv])
    rows = samples.select(F.col(name).alias("name"), x.alias("x")).withColumn("p", pop[F.col("name")])
    base = rows.groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.sum("x").alias("s1"), F.sum(F.col("x") ** 2).alias("s2"), F.first("p").alias("p"))
    pct = lambda q: F.percentile("v", F.lit(q))
    if method in ("percentile", "empirical"):
        v = F.col("x") if method == "percentile" else F.col("x") - F.col("p")
        got = rows.withColumn("v", v).groupBy("name").agg(*[pct(q).alias(k) for q, k in zip(qs, ("low", "high"))])
        shift = F.lit(0.0) if method == "percentile" else F.col("mean")
        out = base.join(got, "name").withColumns({k: F.col(k) + shift for k in ("low", "high")})
    elif method == "normal":
        out = base.withColumns({k: F.col("mean") + normal_ppf(q) * F.col("sd") for q, k in zip(qs, ("low", "high"))})
    elif method == "t":
        stats = {r["name"]: r["n"] for r in base.select("name", "n").collect()}  # one row per statistic
        for q, k in zip(qs, ("low", "high")):
            t = F.create_map(*[F.lit(v) for n, c in stats.items() for v in (n, t_ppf(q, max(1, c - 1)))])
            base = base.withColumn(k, F.col("mean") + t[F.col("name")] * F.col("sd"))
        out = base
    elif method == "t-jackknife":
        one = rows.drop("p").join(base, "name")
        m = (F.col("s1") - F.col("x")) / (F.col("n") - 1)
        var = F.try_divide(F.col("s2") - F.col("x") ** 2 - (F.col("n") - 1) * m * m, F.col("n") - 2)
        one = one.withColumn("v", (F.col("x") - m) / F.sqrt(F.greatest(var, F.lit(1e-12))))
        got = one.where("n >= 3").groupBy("name").agg(*[pct(q).alias(k) for q, k in zip(qs, ("low", "high"))])
        out = base.join(got, "name", "left").withColumns({k: F.col("mean") + F.col(k) * F.col("sd") for k in ("low", "high")})
    else:
        below = rows.groupBy("name").agg(F.avg((F.col("x") < F.col("p")).cast("double")).alias("share"))
        stats = base.join(below, "name")
        if method == "bca":
            one = rows.drop("p").join(base, "name")
            m = (F.col("s1") - F.col("x")) / (F.col("n") - 1)
            var = (F.col("s2") - F.col("x") ** 2 - (F.col("n") - 1) * m * m) / (F.col("n") - 2)
            whole = F.try_divide(F.col("sd") ** 2, F.col("mean") ** 2) - F.try_divide(F.lit(1.0), "mean")
            infl = (F.col("n") - 1) * (whole - (F.try_divide(var, m**2) - F.try_divide(F.lit(1.0), m)))
            acc = one.withColumn("i", infl).groupBy("name").agg(F.coalesce(F.try_divide(F.sum(F.col("i") ** 3), 6 * F.pow(F.sum(F.col("i") ** 2), 1.5)), F.lit(0.0)).alias("a"))
            stats = stats.join(acc, "name")
        else:
            stats = stats.withColumn("a", F.lit(0.0))
        limits = []
        for r in stats.collect():  # one row per statistic
            if r["share"] in (0.0, 1.0):
                raise ValueError(f"'{r['name']}' is too skewed for ci_method '{method}'")
            z = normal_ppf(r["share"])
            limits.append((r["name"], *[normal_cdf(z + (z + normal_ppf(q)) / (1 - r["a"] * (z + normal_ppf(q)))) for q in qs]))
        limits = rows.sparkSession.createDataFrame(limits, "name string, q0 double, q1 double")
        # each statistic has its own quantile: interpolate between the ranks beside it, for all at once
        ranked = rows.where("x IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("x")) - 1).withColumn("m", F.count("*").over(Window.partitionBy("name")) - 1)
        near = lambda q: F.sum(F.col("x") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("r") - F.col(q) * F.col("m"))))
        out = base.join(ranked.join(F.broadcast(limits), "name").groupBy("name").agg(near("q0").alias("low"), near("q1").alias("high")), "name")
    return out.select(F.col("name").alias(name), "low", "mean", "high", (F.col("mean") - F.col("p")).alias("bias"))
