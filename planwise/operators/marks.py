"""Chart-data preparation ("marks"): the data half of each chart kind.

Every operator returns a DataFrame computed by Spark over all rows; drawing
is out of scope.  Per-group statistics are joined back with a size-checked
broadcast, and every aggregate is algebraic (partial aggregation before the
shuffle), so a hot group never funnels into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from planwise.functions.exprs import is_float, missing_label, quote_id, without_nan
from planwise.operators.joins import join_stats
from planwise.operators.review import GuardError, check_coordinates, check_non_negative, check_numeric_axis
from planwise.session import ensure_checkpoint_dir

# Fixed limits of the chart layer (they must equal the reference's).
MAX_MARKS = 20_000
MAX_TABLE_ROWS = 40
MAX_EVIDENCE = 100
MAX_COLUMNS = 10_000  # of a matrix: what Spark's pivot takes, too
HISTOGRAM_BINS = 10
VIOLIN_POINTS = 100
PALETTE_SIZE = 10


def _at_most(df: DataFrame, limit: int, what: str) -> DataFrame:
    if df.limit(limit + 1).count() > limit:
        raise GuardError(f"Over {limit} {what}; aggregate or filter first")
    return df


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with null for NaN: a value that is not a number is missing, as in plans."""
    floats = [c for c in dict.fromkeys(columns) if is_float(df.schema, c)]
    return df.withColumns({c: without_nan(c, df.schema) for c in floats}) if floats else df


def _scalars(df: DataFrame, *exprs: Column):
    return df.agg(*exprs).first()


# ---- V1 / O6 / N7 / O7 -------------------------------------------------------
def bar_marks(result: DataFrame, x: str, y: str, max_marks: int = MAX_MARKS) -> DataFrame:
    """(category, value) marks: numeric value axis, nulls labelled, mark cap.

    Bars lie where only ``x`` is numeric: then it is the value axis and ``y`` names the categories.
    """
    _at_most(result, max_marks, "output marks")
    if is_horizontal(result, x, y):
        x, y = y, x
    check_numeric_axis(result, y)
    result = _numbers(result, y)
    return result.select(missing_label(F.col(x)).alias("category"), F.col(y).cast("double").alias("value"))


def is_horizontal(result: DataFrame, x: str, y: str) -> bool:
    """Whether bars over these axes lie: ``x`` is numeric and ``y`` is not."""
    numeric = [isinstance(result.schema[c].dataType, NumericType) for c in (x, y)]
    return numeric[0] and not numeric[1]


def with_row_index(result: DataFrame, order_by: list[str], max_marks: int = MAX_MARKS) -> DataFrame:
    """A 0-based row index as the x of a single-column result (capped input)."""
    _at_most(result, max_marks, "output marks")
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    return result.withColumn("_index", F.row_number().over(w) - 1)


# ---- V2 histogram --------------------------------------------------------------
def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over non-null values; the last bin is closed.

    Output: bin (1..bins), lower, upper, count - empty bins included.
    """
    df = _numbers(df, value)
    s = _scalars(df, F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = s["lo"], s["hi"]
    if lo is None:
        raise GuardError("histogram needs at least one non-null value")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    v = F.col(value).cast("double")
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)) + 1, F.lit(bins)).cast("bigint")
    counts = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    width = (hi - lo) / bins
    return (spine.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


# ---- V3 box --------------------------------------------------------------------
SELECT_BINS = 4096  # by which an open interval of values is divided
FEW_ROWS = 200_000  # rows in open intervals that are told apart by value at once


def _group_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v): the group and its non-missing values as doubles."""
    return (_numbers(df, value).selectExpr(f"{quote_id(group)} AS g", f"CAST({quote_id(value)} AS DOUBLE) AS v")
            .where("v IS NOT NULL"))


def _quantiles(rows: DataFrame, probs) -> DataFrame:
    """(g, n, q0, q1, ...) of ``rows`` (g, v) by selection: no sort of the rows, only counts are shuffled.

    A round counts the rows of each interval of values and keeps the intervals
    that hold a wanted rank, with their smallest and largest value and the
    number of rows before them; the next round divides these.  The first round
    has one interval for each sign and power of two (at most about 4,200 for a
    group), so that each later one gains 12 bits of the value: at most six
    rounds.  An interval is done when its smallest and largest value are equal.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    prob_list = ", ".join(f"CAST({float(p)!r} AS DOUBLE)" for p in probs)
    at = f"transform(array({prob_list}), p -> p * (n - 1))"
    wanted = (f"exists({at}, p -> floor(p) >= first AND floor(p) < first + c "
              "OR ceil(p) >= first AND ceil(p) < first + c)")
    power = ("CASE WHEN v = 0 THEN 0 WHEN abs(v) = double('Infinity') THEN 3000 * signum(v) "
             "ELSE signum(v) * (1100 + floor(log2(abs(v)))) END")
    found = (rows.groupBy("g", F.expr(power).alias("bin")).agg(F.expr("count(1) AS c"), F.expr("min(v) AS lo"), F.expr("max(v) AS hi"))
             .selectExpr("g", "sum(c) OVER (PARTITION BY g) AS n", "sum(c) OVER (PARTITION BY g ORDER BY bin) - c AS first",
                         "c", "lo", "hi").where(wanted).checkpoint(eager=True))
    done = found.where("lo = hi")
    while True:
        still = found.where("lo < hi")
        intervals, inside = still.agg(F.count("*"), F.sum("c")).first()
        if not intervals:
            break
        bin_ = "v" if inside <= FEW_ROWS else f"CAST(floor((v - lo) / (hi - lo) * {SELECT_BINS}) AS DOUBLE)"
        found = (join_stats(rows, still.select("g", "n", "first", "lo", "hi"), ["g"], known_rows=intervals)
                 .where("v >= lo AND v <= hi")
                 .groupBy("g", "n", F.col("first").alias("base"), F.expr(bin_).alias("bin"))
                 .agg(F.expr("count(1) AS c"), F.expr("min(v) AS lo"), F.expr("max(v) AS hi"))
                 .selectExpr("g", "n", "base + sum(c) OVER (PARTITION BY g, base ORDER BY bin) - c AS first", "c", "lo", "hi")
                 .where(wanted).checkpoint(eager=True))
        done = done.union(found.where("lo = hi"))
    edge = lambda end, i: f"max(CASE WHEN {end}(at[{i}]) >= first AND {end}(at[{i}]) < first + c THEN lo END)"
    between = lambda i: f"({edge('ceil', i)} - {edge('floor', i)}) * (any_value(at)[{i}] - floor(any_value(at)[{i}]))"
    cols = [f"{edge('floor', i)} + CASE WHEN {edge('floor', i)} = {edge('ceil', i)} THEN 0 ELSE {between(i)} END AS q{i}"
            for i in range(len(probs))]
    return done.selectExpr("*", f"{at} AS at").groupBy("g", "n").agg(*[F.expr(c) for c in cols])


def exact_quantiles(df: DataFrame, group: str, value: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear-interpolated quantiles per group, distributed; a null group is a group.

    Selection by counts of value intervals (see ``_quantiles``): ``df`` is read
    once a round, so one that is costly to compute is best cached or stored.
    Output: group, n, q0, q1, ... (one column per probability).
    """
    return _quantiles(_group_values(df, group, value), probs).withColumnRenamed("g", group)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers at observed values, and outlier counts."""
    rows = _group_values(df, group, value)
    q = _quantiles(rows, (0.25, 0.5, 0.75)).selectExpr(
        "g", "n", "q0 AS q1", "q1 AS median", "q2 AS q3",
        "q0 - 1.5 * (q2 - q0) AS lo_fence", "q2 + 1.5 * (q2 - q0) AS hi_fence")
    return join_stats(rows, q, ["g"]).groupBy("g", "n", "q1", "median", "q3").agg(
        F.expr("min(CASE WHEN v >= lo_fence THEN v END) AS lower_whisker"),
        F.expr("max(CASE WHEN v <= hi_fence THEN v END) AS upper_whisker"),
        F.expr("count(CASE WHEN v < lo_fence OR v > hi_fence THEN 1 END) AS outliers")
    ).withColumnRenamed("g", group)


def box_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """The outlier rows themselves (unbounded: returned as a DataFrame)."""
    stats = box_stats(df, group, value).select(group, F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    v = F.col(value)
    return (join_stats(_numbers(df, value), stats, [group])
            .filter((v < F.col("_q1") - 1.5 * iqr) | (v > F.col("_q3") + 1.5 * iqr)).drop("_q1", "_q3"))


# ---- V4 violin -----------------------------------------------------------------
MOMENTS = 20
FAR = 9.5  # bandwidths from a box's middle beyond which its kernels are below 1e-17


def violin_density(df: DataFrame, group: str, value: str, points: int = VIOLIN_POINTS, cut: float = 2.0) -> DataFrame:
    """Gaussian kernel density per group on a ``points`` grid; a null group is a group.

    Bandwidth = sample stddev * n^(-1/5) (Scott's rule); grid spans
    [min - cut*bw, max + cut*bw].  Fast Gauss transform: values fall into boxes
    one bandwidth wide, a box keeps the moments sum(exp(-t*t/2) * t^k), k < 20,
    of its values' distances t from its middle (in bandwidths, |t| <= 1/2), and
    at a grid point z bandwidths from the middle its kernels sum up to
    exp(-z*z/2) * sum(z^k / k! * moment k).  What the series leaves out is less
    than 1e-15 of a kernel's height for each value, and so are points farther
    than ``FAR``.  Moments add up in each task before the shuffle, and a group
    has at most as many boxes as its range has bandwidths.
    A group with one row, without spread or with infinite values has no
    bandwidth: it gives one row at its least value with a null density and
    ``flat`` set.
    Output: group, idx, x, density, flat.
    """
    rows = _group_values(df, group, value)
    stats = rows.groupBy("g").agg(F.expr("count(1) AS n"), F.expr("stddev_samp(v) AS sd"), F.expr("min(v) AS lo"),
                                  F.expr("max(v) AS hi"))
    ensure_checkpoint_dir(df.sparkSession)
    stats = stats.selectExpr("*", "n > 1 AND sd > 0 AND sd < double('Infinity') AS wide").checkpoint(eager=True)
    flat = stats.where("NOT wide").selectExpr("g", "0 AS idx", "lo AS x", "CAST(NULL AS DOUBLE) AS density", "true AS flat")
    grids = (stats.where("wide").selectExpr("*", "sd * pow(CAST(n AS DOUBLE), -0.2D) AS bw")
             .selectExpr("g", "n", "lo", "bw", f"lo - {cut}D * bw AS start", f"(hi - lo + 2 * {cut}D * bw) / {points - 1} AS step"))
    t = "(v - middle) / bw"
    boxes = (join_stats(rows, grids, ["g"], known_rows=stats.count())
             .selectExpr("*", "lo + (floor((v - lo) / bw) + 0.5D) * bw AS middle")
             .selectExpr("g", "n", "bw", "start", "step", "middle", f"{t} AS t", f"exp(-0.5D * ({t}) * ({t})) AS w")
             .groupBy("g", "n", "bw", "start", "step", "middle")
             .agg(*[F.expr(f"sum(w * pow(t, {k}.0D)) AS m{k}") for k in range(MOMENTS)]))
    near = (boxes.selectExpr("*", f"greatest(0, ceil((middle - {FAR}D * bw - start) / step)) AS a",
                             f"least({points - 1}, floor((middle + {FAR}D * bw - start) / step)) AS b")
            .where("a <= b").withColumn("idx", F.expr("explode(sequence(CAST(a AS INT), CAST(b AS INT)))"))
            .withColumn("z", F.expr("(start + idx * step - middle) / bw")))
    series = f"m{MOMENTS - 1}"
    for k in reversed(range(MOMENTS - 1)):
        series = f"(m{k} + z / {k + 1} * {series})"
    key = ["g", "n", "bw", "start", "step", "idx"]
    empty = grids.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*key, F.lit(0.0).alias("k"))
    dens = near.select(*key, F.expr(f"exp(-0.5D * z * z) * {series} AS k")).unionByName(empty).groupBy(*key).agg(F.sum("k").alias("k"))
    return (dens.selectExpr("g", "idx", "start + idx * step AS x", f"k / (n * bw * {math.sqrt(2 * math.pi)!r}D) AS density",
                            "false AS flat")
            .unionByName(flat).withColumnRenamed("g", group))


# ---- V5 heatmap / V6 facets ------------------------------------------------------
def heatmap_matrix(result: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Pivot two keys to a matrix; a duplicate cell is an error, never merged.
    The column names of the matrix, at most MAX_COLUMNS, pass through the driver; more are an error."""
    values = [r[0] for r in result.select(col).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(values) > MAX_COLUMNS:
        raise GuardError(f"Over {MAX_COLUMNS} heatmap columns; aggregate or filter first")
    values = sorted(values, key=lambda v: (v is None, str(v)))
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("Heatmap has duplicate cells"))).otherwise(F.first(value))
    return result.groupBy(row).pivot(col, values).agg(cell)


def facet_values(result: DataFrame, key: str) -> DataFrame:
    return result.select(key).distinct()


# ---- V8 sankey / V9 tree / V10 funnel ----------------------------------------------
def sankey_links(result: DataFrame, source: str, target: str, value: str) -> DataFrame:
    check_non_negative(result, value)
    return result.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"),
                         F.col(value).alias("value"))


def sankey_nodes(result: DataFrame, source: str, target: str) -> DataFrame:
    return (result.select(F.col(source).cast("string").alias("name"))
            .union(result.select(F.col(target).cast("string").alias("name"))).distinct())


def tree_rows(result: DataFrame, name: str, value: str, root: str) -> DataFrame:
    """A root with one child per row: (parent, name, value)."""
    return result.select(F.lit(root).alias("parent"), F.col(name).cast("string").alias("name"), F.col(value).alias("value"))


def funnel_stages(result: DataFrame, stage: str, value: str) -> DataFrame:
    check_non_negative(result, value)
    return result.select(F.col(stage).cast("string").alias("stage"), F.col(value).alias("value"))


# ---- V11 / V12 density raster ------------------------------------------------------
def density_raster(df: DataFrame, x: str, y: str, width: int, height: int,
                   x_range: tuple[float, float] | None = None,
                   y_range: tuple[float, float] | None = None) -> DataFrame:
    """Point counts per pixel over the full data (or a viewport); points
    outside the ranges are dropped.  Output: px, py, count."""
    if x == y:
        raise GuardError("a density needs two fields")
    df = _numbers(df, x, y)
    if x_range is None or y_range is None:
        s = _scalars(df, F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        x_range = x_range or (float(s["x0"]), float(s["x1"]))
        y_range = y_range or (float(s["y0"]), float(s["y1"]))
    (x0, x1), (y0, y1) = x_range, y_range
    xs, ys = (x1 - x0) or 1.0, (y1 - y0) or 1.0
    inside = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    px = F.least(F.floor((F.col(x) - F.lit(x0)) / F.lit(xs) * F.lit(width)), F.lit(width - 1)).cast("bigint")
    py = F.least(F.floor((F.col(y) - F.lit(y0)) / F.lit(ys) * F.lit(height)), F.lit(height - 1)).cast("bigint")
    return inside.groupBy(px.alias("px"), py.alias("py")).agg(F.count(F.lit(1)).alias("count"))


def density_shade(raster: DataFrame) -> DataFrame:
    """The raster with ``shade``, each count's logarithmic share of the largest: log(1 + count) / log(1 + max)."""
    top = raster.agg(F.max("count")).scalar()
    return raster.withColumn("shade", F.log1p("count") / F.log1p(top))


def density_stats(raster: DataFrame) -> DataFrame:
    return raster.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("points_in_view"),
                      F.coalesce(F.max("count"), F.lit(0)).alias("max_count"))


# ---- V13 geo / V14 / V15 colours / V16 table ------------------------------------------
def geo_view(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Checked WGS84 points and the view centre (mean lon/lat)."""
    check_coordinates(df, lon, lat)
    return df.agg(F.count(F.lit(1)).alias("points"), F.avg(lon).alias("center_lon"), F.avg(lat).alias("center_lat"))


def color_scale(result: DataFrame, value: str) -> DataFrame:
    """Value normalised to [0, 1] by the result's min and max."""
    result = _numbers(result, value)
    s = _scalars(result, F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.lit(s["hi"]) - F.lit(s["lo"])
    return result.withColumn("color_t", F.try_divide(F.col(value) - F.lit(s["lo"]), span))


def color_codes(result: DataFrame, category: str) -> DataFrame:
    """Palette index per category (ordered by category), modulo palette size.

    Distinct categories are sorted by range partitions; a category's rank is its place in its partition plus the
    sizes of the earlier ones, of which there is one number for each partition.
    """
    ensure_checkpoint_dir(result.sparkSession)
    order = F.col(category).asc_nulls_last()
    cats = (result.select(category).distinct().repartitionByRange(order).sortWithinPartitions(order)
            .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True))  # partition << 33, place
    part = F.shiftright("_at", 33)
    sizes = cats.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    codes = (cats.withColumn("_part", part).join(F.broadcast(before), "_part")
             .select(category, (place % PALETTE_SIZE).cast("int").alias("color_code")))
    return join_stats(result, codes, [category])


def kpi_table(result: DataFrame, label: str, value: str, descending: bool = True,
              max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """At most ``max_rows`` ranked rows with a rank column; more is an error."""
    _at_most(result, max_rows, "table rows")
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return result.select(label, value, F.row_number().over(Window.orderBy(order, F.col(label).asc_nulls_last())).alias("rank"))


def top_evidence(result: DataFrame, value: str, keys: list[str], limit: int = MAX_EVIDENCE) -> DataFrame:
    """First ``limit`` groups by value (desc) with 1-based IDs, the total
    group count and how many of the groups are included.  The top-k runs per partition before one small merge; the
    total is a scalar subquery of the same lazy query (Catalyst prunes it to
    counting the group keys, reading only the key columns)."""
    order = [F.col(value).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    total = result.agg(F.count(F.lit(1))).scalar()
    top = result.orderBy(*order).limit(limit)
    return (top.withColumn("evidence_id", F.row_number().over(Window.orderBy(*order)))
            .withColumns({"total_groups": total, "included_groups": F.least(total, F.lit(limit).cast("bigint"))}))
