"""Filters, identifiers, region names, interval repair and transect geometry of raw survey rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.ranking import exact_median
from pelagia.sources.xlsx import read_xlsx


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def _member(name: str, wanted) -> Column:
    if isinstance(wanted, tuple) and len(wanted) == 2:  # an interval, open on the left
        return (F.col(name) > wanted[0]) & (F.col(name) <= wanted[1])
    values = list(wanted) if isinstance(wanted, (list, set, frozenset)) else [wanted]
    return F.col(name).isin(values)


def apply_filters(df: DataFrame, include: Mapping | None = None, exclude: Mapping | None = None, replace: Mapping | None = None, strict: bool = True) -> DataFrame:
    """Rows that meet every ``include`` and no ``exclude`` condition.

    A null meets no condition, so it is dropped by ``include`` and kept by
    ``exclude``. With ``replace`` (column: value) rows stay and those columns
    are overwritten instead. Unknown columns raise unless ``strict`` is off.
    """
    keep = F.lit(True)
    for conditions, wanted in ((include or {}, True), (exclude or {}, False)):
        for name, values in conditions.items():
            if name not in df.columns:
                if strict:
                    raise KeyError(name)
                continue
            hit = F.coalesce(_member(name, values), F.lit(False))
            keep = keep & (hit if wanted else ~hit)
    if replace is None:
        return df.where(keep)
    return df.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(v)) for c, v in replace.items()})


def ship_survey_filter(df: DataFrame, ships: Mapping[int, Mapping], species: Sequence | None = None) -> DataFrame:
    """Rows of the given ships and surveys; each ship's haul offset is added to haul_num."""
    offset, keep = F.lit(0), F.lit(False)
    for ship, spec in ships.items():
        of = F.col("ship") == ship
        if "survey" in spec:
            of = of & F.col("survey").isin(*spec["survey"])
        keep = keep | of
        offset = F.when(F.col("ship") == ship, spec.get("haul_offset", 0)).otherwise(offset)
    out = df.where(keep).withColumn("haul_num", F.col("haul_num") + offset)
    return out.where(F.col("species_code").isin(*species)) if species else out


def map_labels(df: DataFrame, labels: Mapping[str, Mapping]) -> DataFrame:
    """Replace values by their label; values without one stay."""
    out = {}
    for name, mapping in labels.items():
        pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        out[name] = F.coalesce(pairs[F.col(name)], F.col(name).cast("string"))
    return df.withColumns(out)


def composite_key(frames: Sequence[DataFrame], columns: Sequence[str], adjust: Mapping[str, float] | None = None) -> DataFrame:
    """Distinct key columns over all frames with ``uid``, their values joined by '-'."""
    keys = None
    for df in frames:
        part = df.select(*columns)
        keys = part if keys is None else keys.unionByName(part)
    shown = []
    for c in columns:
        by = (adjust or {}).get(c)
        shown.append(F.col(c) if by is None else F.when(F.col(c) + by > 0, F.col(c) + by).otherwise(F.col(c)))
    return keys.dropDuplicates().withColumn("uid", F.concat_ws("-", *[s.cast("string") for s in shown]))


def apply_composite_key(df: DataFrame, key: DataFrame, haul_offset: tuple[int, int] | None = None) -> DataFrame:
    """Attach ``uid`` by all shared columns; ``haul_offset`` is (ship, offset)."""
    if haul_offset:
        df = df.withColumn("haul_num", F.col("haul_num") + F.when(F.col("ship") == haul_offset[0], haul_offset[1]).otherwise(0))
    df = df.drop("uid")
    return df.join(key, [c for c in key.columns if c in df.columns], "left")


def haul_uid(df: DataFrame, ship_us: int = 1, ship_can: int = 2, survey_us: int = 1, survey_can: int = 2, species: int = 99999, can_haul_offset: int = 0) -> DataFrame:
    """``uid`` = ship-survey-species-haul; a haul at or above the offset is Canadian.

    A column of the frame wins over the default; with the default offset 0 every haul is Canadian.
    """
    can = F.col("haul_num") - can_haul_offset >= 0
    haul = F.when(can, F.col("haul_num") - can_haul_offset).otherwise(F.col("haul_num"))
    part = lambda name, us, ca: F.col(name).cast("string") if name in df.columns else F.when(can, str(ca)).otherwise(str(us))
    return df.withColumn("uid", F.concat_ws("-", part("ship", ship_us, ship_can), part("survey", survey_us, survey_can), part("species_code", species, species), haul.cast("string")))


def clean_cells(df: DataFrame, name: str = "region_name", kind: str = "region_class") -> DataFrame:
    """Quotes and outer blanks off both region columns; the class in lower case."""
    bare = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    return df.withColumns({name: bare(name), kind: F.lower(bare(kind))})


def parse_regions(df: DataFrame, patterns: Mapping[str, Mapping[str, str | None]], name: str = "region_name") -> DataFrame:
    """Parts of region names by ordered patterns, case ignored.

    Each part takes its first matching pattern; the match goes, once, from what
    later parts see. A pattern's label is given, or the matched text if None.
    Parsing runs on distinct names only.
    """
    rest, out = F.col(name), {}
    for part, options in patterns.items():
        text, label = F.lit(None).cast("string"), F.lit(None).cast("string")
        for pattern, tag in reversed(list(options.items())):
            found = F.regexp_extract(rest, f"(?i){pattern}", 0)
            hit = rest.rlike(f"(?i){pattern}")
            text = F.when(hit, found).otherwise(text)
            label = F.when(hit, F.lit(tag) if tag is not None else found).otherwise(label)
        out[part] = label
        at = F.instr(rest, F.coalesce(text, F.lit("")))
        rest = F.when(text.isNull() | (text == ""), rest).otherwise(F.concat(rest.substr(F.lit(1), at - 1), rest.substr(at + F.length(text), F.length(rest))))
    parts = df.select(name).distinct().select(name, *[v.alias(k) for k, v in out.items()])
    return df.join(parts, name, "left")


def typed_regions(df: DataFrame, can_haul_offset: float | None = None) -> DataFrame:
    """Parsed parts with their types: haul and ship numbers as doubles, Canadian hauls moved by the offset."""
    out = df.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("haul_num", "ship") if c in df.columns})
    if "country" in df.columns and "haul_num" in df.columns and can_haul_offset is not None:
        out = out.withColumn("haul_num", F.col("haul_num") + F.when(F.col("country") == "CAN", can_haul_offset).otherwise(0.0))
    return out


def valid_filesets(files: DataFrame, kinds: Sequence[str], transect: str = "transect_num", kind: str = "file_type") -> DataFrame:
    """Files of transects that have exactly one of every kind."""
    one = [F.count_if(F.col(kind) == k) == 1 for k in kinds]
    good = files.groupBy(transect).agg(*[c.alias(f"_{i}") for i, c in enumerate(one)])
    for i in range(len(kinds)):
        good = good.where(f"_{i}")
    return files.join(good.select(transect), transect, "left_semi")


def merge_exports(intervals: DataFrame, cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Cells with their interval's and layer's columns, by all shared columns; rows without an interval or NASC go."""
    out = cells.join(intervals, [c for c in cells.columns if c in intervals.columns], "left")
    out = out.join(layers, [c for c in out.columns if c in layers.columns], "left")
    return out.where(F.col("interval").isNotNull() & F.col("nasc").isNotNull())


def region_haul_key(cells: DataFrame, classes: Sequence[str], order: str = "seq") -> DataFrame:
    """The first row of each transect, haul and region of the wanted classes."""
    rest = [c for c in cells.columns if c not in ("transect_num", "haul_num", "region_id", order)]
    rows = cells.where(F.lower("region_class").isin(*[c.lower() for c in classes]))
    return rows.groupBy("transect_num", "haul_num", "region_id").agg(*[F.min_by(c, order).alias(c) for c in rest])


def layer_depths(cells: DataFrame) -> DataFrame:
    """Deepest edge, mean depth and height of each interval's layers."""
    deep, top = F.max("layer_depth_max"), F.min("layer_depth_min")
    return cells.groupBy("transect_num", "interval").agg(deep.alias("max_depth"), ((top + deep) / 2).alias("layer_mean_depth"), (deep - top).alias("layer_height"))


def consolidate(nasc: DataFrame, template: DataFrame, key: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per interval of the template: NASC of the wanted classes, summed, with haul and layer.

    The first region of an interval stands for it; intervals without any get
    region 999, haul 0 and zero NASC and depth.
    """
    rows = nasc.where(F.lower("region_class").isin(*[c.lower() for c in classes]))
    first = rows.groupBy("transect_num", "interval").agg(F.min_by("region_id", "seq").alias("region_id"))
    sums = rows.groupBy("transect_num", "interval").agg(F.sum("nasc").alias("nasc"))
    found = sums.join(first, ["transect_num", "interval"]).join(layer_depths(rows), ["transect_num", "interval"]).join(key.select("transect_num", "region_id", "haul_num"), ["transect_num", "region_id"])
    out = template.join(found, ["transect_num", "interval"], "left")
    return out.fillna({"region_id": 999, "haul_num": 0, "nasc": 0.0, "max_depth": 0.0, "layer_mean_depth": 0.0, "layer_height": 0.0})


def transect_spacing(df: DataFrame, default: float = 10.0, threshold: float = 60.0) -> DataFrame:
    """Spacing of the middle one of three consecutive transects, from the mean latitudes of its neighbours."""
    low = F.when(F.col("latitude") < threshold, F.col("latitude"))
    by = df.groupBy("transect_num").agg(F.avg(low).alias("m"), (F.max(low) - F.min(low)).alias("r"))
    w = Window.orderBy("transect_num")  # one row per transect
    gap = F.abs(F.lead("m").over(w) - F.lag("m").over(w))
    near = (gap <= 2.0 * default * 1.1 / 30.0) & (F.lag("r").over(w) < 1 / 6) & (F.lead("r").over(w) < 1 / 6)
    spaced = by.select("transect_num", F.when(near, gap * 30.0).otherwise(default).alias("transect_spacing"))
    return df.join(spaced, "transect_num")


def interval_distance(df: DataFrame, threshold: float = 0.05, group: str = "transect_num", order: str = "interval") -> DataFrame:
    """Distance to the start of the next interval in survey order; end minus start where that is far from the median.

    The next row is looked up within the transect; a transect's last row looks at
    the next transect's first, so no window spans the survey.
    """
    w = Window.partitionBy(group).orderBy(order)
    heads = df.groupBy(group).agg(F.min_by("distance_s", order).alias("_head")).withColumn("_next_head", F.lead("_head").over(Window.orderBy(group))).drop("_head")
    out = df.withColumn("_next", F.lead("distance_s").over(w)).join(heads, group)
    out = out.withColumn("_d", F.abs(F.col("distance_s") - F.coalesce("_next", "_next_head")))
    out = out.withColumn("_d", F.coalesce("_d", F.col("distance_e") - F.col("distance_s")))
    middle = exact_median(out, "_d")
    far = F.abs(F.col("_d") - F.lit(middle)) > threshold
    return out.withColumn("distance_interval", F.when(far, F.col("distance_e") - F.col("distance_s")).otherwise(F.col("_d"))).drop("_d", "_next", "_next_head")


def impute_coordinates(df: DataFrame, column: str, group: str, order: str, bad: float = 999.0) -> DataFrame:
    """Straight lines through bad (``bad`` or null) coordinates.

    A bad run at the head or tail extends the nearest two rows; one inside
    joins the good values on both sides.
    """
    w = Window.partitionBy(group).orderBy(order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # looking ahead is looking back in the opposite order: one pass, where an open-ended frame takes one per row
    back = Window.partitionBy(group).orderBy(F.col(order).desc())
    before, after = (v.rowsBetween(Window.unboundedPreceding, -1) for v in (w, back))
    out = df.withColumn("_i", F.row_number().over(w)).withColumn("_x", F.when(F.coalesce(F.col(column) == bad, F.lit(True)), None).otherwise(F.col(column)))
    at = F.when(F.col("_x").isNotNull(), F.col("_i"))
    out = out.withColumns({"_pi": F.last(at, True).over(before), "_px": F.last("_x", True).over(before), "_ni": F.last(at, True).over(after), "_nx": F.last("_x", True).over(after), "_f": F.min(at).over(all_), "_l": F.max(at).over(all_)})
    at_row = lambda i: F.max(F.when(F.col("_i") == i, F.col("_x"))).over(all_)
    out = out.withColumns({"_xf1": at_row(F.col("_f") + 1), "_xl1": at_row(F.col("_l") - 1)})
    head = F.col("_nx") - (F.col("_f") - F.col("_i")) * (F.col("_xf1") - F.col("_nx"))
    tail = F.col("_px") + (F.col("_i") - F.col("_l")) * (F.col("_px") - F.col("_xl1"))
    inside = F.col("_px") + (F.col("_nx") - F.col("_px")) / (F.col("_ni") - F.col("_pi")) * (F.col("_i") - F.col("_pi"))
    fixed = F.when(F.col("_x").isNotNull(), F.col("_x")).when(F.col("_pi").isNull(), head).when(F.col("_ni").isNull(), tail).otherwise(inside)
    return out.withColumn(column, fixed).drop("_i", "_x", "_pi", "_px", "_ni", "_nx", "_f", "_l", "_xf1", "_xl1")


def listed_ranges(listed: DataFrame) -> DataFrame:
    """A table of ranges with its columns in lower case, ``transect`` as transect_num; KeyError where one lacks.

    Of columns that differ in case only the first counts.
    """
    names: dict[str, str] = {}
    for c in listed.columns:
        names.setdefault(c.lower(), c)
    if "transect_num" not in names and "transect" in names:
        names = {"transect_num" if n == "transect" else n: c for n, c in names.items()}
    if missing := [c for c in ("transect_num", "log_start", "log_end") if c not in names]:
        raise KeyError(f"the ranges lack {', '.join(missing)}")
    places = {c: k for k, c in reversed(list(enumerate(listed.columns)))}
    plain = listed.toDF(*[f"_{k}" for k in range(len(listed.columns))])  # names that differ in case only are ambiguous
    return plain.select(*[F.col(f"_{places[c]}").alias(n) for n, c in names.items()])


def filter_intervals(df: DataFrame, listed: DataFrame | str, condition: str | None = None, sheet: str | int = 0) -> DataFrame:
    """Intervals of transects not in ``listed`` (transect_num, log_start, log_end), and those overlapping a listed range.

    ``listed`` is a table or the path of a workbook, whose ``sheet`` is read; a
    condition keeps some of its rows first.
    """
    if isinstance(listed, str):
        listed = read_xlsx(df.sparkSession, listed, sheet)
    listed = listed_ranges(listed)
    listed = listed.where(condition) if condition else listed
    free = df.join(listed.select("transect_num").distinct(), "transect_num", "left_anti")
    return free.unionByName(overlapping(df, listed))


#: Stretches of the distance by which a transect's intervals and ranges are dealt.
STRETCHES = 64


def overlapping(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``df`` whose interval overlaps one of its transect's ranges, ends included.

    One does if, of the ranges that begin by the interval's end, the farthest end lies
    at or behind its start: a running maximum along the distance, within stretches of
    it, which start with what the stretches before them reach. So no pair of an
    interval and a range is formed.
    """
    rows = df.where(F.col("transect_num").isNotNull() & F.col("distance_s").isNotNull() & F.col("distance_e").isNotNull())
    spots = rows.select(F.col("transect_num").alias("_t"), F.col("distance_e").cast("double").alias("_at"), F.col("distance_s").cast("double").alias("_s"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    given = listed.select(F.col("transect_num").alias("_listed"), F.col("log_start").cast("double").alias("_at"), F.col("log_end").cast("double").alias("_end")).where("_at IS NOT NULL AND _end IS NOT NULL")
    own = rows.select(F.col("transect_num").alias("_t")).distinct()
    ranges = given.join(own, F.col("_listed") == F.col("_t")).select("_t", "_at", "_end")
    s = spots.select("_at").unionByName(given.select("_at")).agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    lo, width = s["lo"] or 0.0, ((s["hi"] or 0.0) - (s["lo"] or 0.0)) / STRETCHES or 1.0
    stretch = F.floor((F.col("_at") - lo) / width).alias("_b")
    ranges = ranges.select("*", stretch)
    ends = ranges.groupBy("_t", "_b").agg(F.max("_end").alias("_end"))
    every = ends.select("_t").distinct().withColumn("_b", F.explode(F.expr(f"sequence(0L, {STRETCHES}L)"))).join(ends, ["_t", "_b"], "left")
    before = every.select("_t", "_b", F.max("_end").over(Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_end")).where("_end IS NOT NULL")
    # what the stretches before reach stands ahead of all, ranges ahead of intervals that end where they begin
    starts = before.withColumn("_at", F.lit(float("-inf"))).unionByName(ranges)
    along = spots.select("*", stretch, F.lit(None).cast("double").alias("_end")).unionByName(starts, allowMissingColumns=True)
    reach = F.max("_end").over(Window.partitionBy("_t", "_b").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return along.withColumn("_reach", reach).where("_row IS NOT NULL AND _reach >= _s").select("_row.*")


def western_extents(df: DataFrame, x: str = "longitude", y: str = "latitude", threshold: float = 51.0) -> DataFrame:
    """The westernmost point of every transect below the latitude."""
    return df.where(F.col(y) < threshold).groupBy("transect_num").agg(F.min(x).alias(x), F.min_by(y, F.struct(x, y)).alias(y))
