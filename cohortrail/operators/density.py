"""Gaussian kernel density of a discrete measure, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the usual rule-of-thumb bandwidth: 0.9 * min(sd, IQR / 1.34) * n ** -0.2
BANDWIDTH_FACTOR = 0.9
IQR_TO_SD = 1.34


def _shapes(group: str, stats: DataFrame) -> DataFrame:
    """Size and bandwidth of each group, and the range over all of them."""
    iqr_scale = (F.col("q")[1] - F.col("q")[0]) / IQR_TO_SD
    positive = [
        F.when(x > 0, x)
        for x in (F.least(F.col("sd"), iqr_scale), F.col("sd"), F.abs("group_lo"), F.lit(1.0))
    ]
    # One row per group here, so the range over all groups is a window over a handful of rows.
    everything = Window.partitionBy()
    return stats.select(
        group,
        F.col("n").alias("group_n"),
        (BANDWIDTH_FACTOR * F.coalesce(*positive) * F.pow(F.col("n"), F.lit(-0.2))).alias("bw"),
        F.min("group_lo").over(everything).alias("lo"),
        F.max("group_hi").over(everything).alias("hi"),
    )


def kernel_density(
    df: DataFrame, *, group: str, measure: str, grid_points: int = 512, binned: bool = False
) -> DataFrame:
    """Density of ``measure`` at equally spaced points over the range of all groups.

    The measure is reduced to (group, value, weight) first; with whole years of age that leaves
    at most one row per year, and every later step works on those.

    ``binned`` is for continuous measures, whose values are nearly all different: each value's
    weight is split between the two grid points beside it, in proportion to their nearness, and the
    kernel runs from grid point to grid point. Its work depends on the grid and not on the data; the
    bandwidth comes from all values still, with quartiles from a sketch of fixed size. The density
    is off by about the square of the grid's step over the bandwidth, divided by eight.
    """
    if binned:
        return _binned_density(df, group, measure, grid_points)
    cells = (
        df.where(F.col(measure).isNotNull())
        .groupBy(group, F.col(measure).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    v, w = F.col("v"), F.col("w")
    n = F.sum(w)
    mean = F.sum(v * w) / n
    stats = cells.groupBy(group).agg(
        n.alias("n"),
        F.sqrt(
            F.greatest((F.sum(v * v * w) - n * mean * mean) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        ).alias("sd"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)), w).alias("q"),
        F.min(v).alias("group_lo"),
        F.max(v).alias("group_hi"),
    )
    shapes = _shapes(group, stats)
    step = (F.col("hi") - F.col("lo")) / (grid_points - 1)
    return _on_grid(cells.join(shapes, group), group, step, grid_points)


def _on_grid(cells: DataFrame, group: str, step: Column, grid_points: int) -> DataFrame:
    """The kernels of all (v, w) rows of a group, added up at each grid point."""
    v, w = F.col("v"), F.col("w")
    points = cells.select(
        group,
        "v",
        "w",
        "bw",
        "group_n",
        "lo",
        step.alias("step"),
        F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("point"),
    )
    x = F.col("lo") + F.col("point") * F.col("step")
    u = (x - v) / F.col("bw")
    kernel = w * F.exp(-u * u / 2) / (F.col("group_n") * F.col("bw") * F.sqrt(2 * F.pi()))
    return points.groupBy(group, "point").agg(
        F.min(x).alias("x"), F.sum(kernel).alias("density"), F.min("bw").alias("bw")
    )


def _binned_density(df: DataFrame, group: str, measure: str, grid_points: int) -> DataFrame:
    values = df.where(F.col(measure).isNotNull()).select(group, F.col(measure).cast("double").alias("v"))
    stats = values.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"),
        F.percentile_approx("v", [0.25, 0.75], 10000).alias("q"),
        F.min("v").alias("group_lo"),
        F.max("v").alias("group_hi"),
    )
    shapes = _shapes(group, stats)
    # Two numbers, so that values meet the grid where they are read.
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        lo = hi = 0.0
    step = (hi - lo) / (grid_points - 1)
    place = (F.col("v") - lo) / step if step > 0 else F.lit(0.0)
    left = F.least(F.floor(place), F.lit(grid_points - 2)).cast("int")
    beside = F.array(
        F.struct(left.alias("at"), (1 - (place - left)).alias("share")),
        F.struct((left + 1).alias("at"), (place - left).alias("share")),
    )
    weights = (
        values.select(group, F.inline(beside))
        .groupBy(group, "at")
        .agg(F.sum("share").alias("w"))
        .where("w > 0")
    )
    cells = weights.join(shapes, group).withColumn("v", lo + F.col("at") * step)
    return _on_grid(cells, group, F.lit(step), grid_points)
