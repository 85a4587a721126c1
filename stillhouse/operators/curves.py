"""Ordered signals (sample, x, y): statistics, weighted quantiles and histograms, peaks, interpolation.

Curves are tables with columns sample, x and y; x and y are doubles. Rows with a null count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_points(points: DataFrame, excluded: tuple[float, float] | None = None) -> DataFrame:
    """Points without nulls and NaN, without those in the excluded window (ends included), equal x of a sample averaged."""
    p = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    if excluded:
        p = p.filter(~F.col("x").between(*excluded))
    return p.groupBy("sample", "x").agg(F.avg("y").alias("y"))


def curve_statistics(points: DataFrame) -> DataFrame:
    """Per sample: number of points, x range, |y|-weighted mean, x of the largest |y| (smallest x on ties), quantiles of |y|."""
    p = points.withColumn("a", F.abs("y"))
    g = p.groupBy("sample").agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.sum("a").alias("total"), (F.sum(F.col("x") * F.col("a")) / F.sum("a")).alias("x_mean"),
        F.max_by("x", F.struct("a", (-F.col("x")).alias("m"))).alias("x_peak"), F.expr("percentile(a, array(0.5, 0.9, 0.99))").alias("q"),
    )
    return g.filter("total > 0").select("sample", "n", "x_min", "x_max", "total", "x_mean", "x_peak", *[F.col("q")[i].alias(f"y_q{n}") for i, n in enumerate((50, 90, 99))])


def weighted_quantiles(points: DataFrame, shares: list[float]) -> DataFrame:
    """Per sample the smallest x at which the running |y| reaches each share of the total."""
    w = Window.partitionBy("sample").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("a", F.abs("y")).withColumns({"upto": F.sum("a").over(w), "total": F.sum("a").over(Window.partitionBy("sample"))})
    return p.filter("total > 0").groupBy("sample").agg(*[F.min(F.when(F.round(F.col("upto") - F.lit(q) * F.col("total"), 9) >= 0, F.col("x"))).alias(f"q{round(q * 100):02d}") for q in shares])


def weighted_histogram(points: DataFrame, bins: int) -> DataFrame:
    """(sample, bin, share): |y| in equal bins between the sample's ends, the right end in the last; shares sum to 1."""
    e = points.groupBy("sample").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.abs("y")).alias("total")).filter("hi > lo and total > 0")
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    return points.join(e, "sample").groupBy("sample", at.alias("bin")).agg((F.sum(F.abs("y")) / F.first("total")).alias("share"))


def nearest_within(left: DataFrame, right: DataFrame, tolerance: float, k: int) -> DataFrame:
    """(sample, x, rx, ry, delta, rank): for each point of ``left`` (sample, x) its k nearest points of ``right`` (sample, rx, ry)
    within the tolerance, ties to the smaller rx.

    A range join as an equi-join: right points are put into the buckets of width ``tolerance`` on both sides of
    their own, so that each left point meets only its own bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("bigint")
    r = right.withColumn("b", F.explode(F.sequence(bucket("rx") - 1, bucket("rx") + 1)))
    near = left.withColumn("b", bucket("x")).join(r, ["sample", "b"]).withColumn("delta", F.abs(F.col("x") - F.col("rx"))).filter(F.col("delta") <= tolerance)
    w = Window.partitionBy("sample", "x").orderBy("delta", "rx")
    return near.drop("b").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def peaks_in_windows(points: DataFrame, windows: list[tuple[str, float, float]], k: int) -> DataFrame:
    """(sample, window, x, y, rank): the k largest y of each fixed window (ends included), ties to the smaller x."""
    name: Column = F.filter(F.array(*[F.when(F.col("x").between(lo, hi), F.lit(n)) for n, lo, hi in windows]), lambda v: v.isNotNull())
    p = points.select("sample", "x", "y", F.explode(name).alias("window"))
    w = Window.partitionBy("sample", "window").orderBy(F.desc("y"), "x")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def interpolate(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(sample, gx, gy): each sample's curve on the grid (column gx), straight between points, flat beyond the ends.

    Points and grid positions are sorted together per sample; the points before and behind come from windows.
    """
    samples = points.select("sample").distinct()
    g = samples.join(F.broadcast(grid)).select("sample", F.col("gx").alias("p"), F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"), F.lit(1).alias("g"))  # grid: a bounded parameter
    both = g.unionByName(points.select("sample", F.col("x").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(0).alias("g")))
    w = Window.partitionBy("sample").orderBy("p", "g")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    z = both.select("sample", "p", "g", *[F.last(c, True).over(back).alias(f"l{c}") for c in ("px", "py")], *[F.first(c, True).over(ahead).alias(f"r{c}") for c in ("px", "py")])
    y = F.when(F.col("lpx").isNull(), F.col("rpy")).when(F.col("rpx").isNull() | (F.col("rpx") == F.col("lpx")), F.col("lpy")).otherwise(F.col("lpy") + (F.col("rpy") - F.col("lpy")) * (F.col("p") - F.col("lpx")) / (F.col("rpx") - F.col("lpx")))
    return z.filter("g = 1").select("sample", F.col("p").alias("gx"), y.alias("gy"))
