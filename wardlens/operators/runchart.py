"""Run charts: median centre line and the signal for non-random variation.

Rule: Anhøj and Olesen, "Run charts revisited", PLoS ONE 2014. Points on the
median are not counted. A signal is a run on one side longer than
round(log2(n) + 3), or fewer crossings than the 5 % quantile of a binomial
distribution with n - 1 trials and probability one half.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators.prefix import PIECE, piece
from wardlens.schema import as_list

AGGREGATES = {"sum": F.sum, "mean": F.avg, "median": F.median}


def fewest_crossings(points: Column) -> Column:
    """5 % quantile of a binomial distribution with ``points - 1`` trials and probability one half.

    Adds the probabilities from 0 crossings on, each from the one before in logarithms, and
    keeps the first number at which their sum reaches 0.05.
    """
    trials = points - 1
    start = F.struct(
        (trials * -math.log(2)).alias("log"),
        F.exp(trials * -math.log(2)).alias("total"),
        F.when(F.exp(trials * -math.log(2)) >= 0.05, 0).alias("quantile"),
    )

    def one_more(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log((trials - k + 1) / k)
        total = acc["total"] + F.exp(log)
        return F.struct(
            log.alias("log"),
            total.alias("total"),
            F.coalesce(acc["quantile"], F.when(total >= 0.05, k)).alias("quantile"),
        )

    # The quantile lies below the mean.
    steps = F.when(trials > 1, F.sequence(F.lit(1), F.ceil(trials / 2).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, start, one_more, lambda acc: acc["quantile"])


def _limits(chart: DataFrame) -> DataFrame:
    """Both limits for each number of useful points that occurs."""
    points = F.col("n_useful")
    return chart.select("n_useful").distinct().filter(points > 0).select(
        "n_useful",
        F.round(F.log2(points) + 3).cast("int").alias("longest_run_max"),
        fewest_crossings(points).alias("n_crossings_min"),
    )


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of pieces, numbered through; those at the ends of neighbours on one side are one."""
    ends = runs.groupBy(PIECE).agg(
        F.min_by("side", "run").alias("first"), F.max_by("side", "run").alias("last"), F.max("run").alias("crossings")
    )
    over = Window.partitionBy().orderBy(PIECE)
    begins = F.coalesce((F.col("first") != F.lag("last").over(over)).cast("int"), F.lit(0))
    starts = ends.withColumn("more", begins + F.lag("crossings", 1, 0).over(over))
    starts = starts.select(PIECE, F.sum("more").over(over).alias("start"))
    return runs.join(starts, PIECE).select((F.col("start") + F.col("run")).alias("run"), "length")


def _side() -> Column:
    return F.when(F.col("y") > F.col("centre"), 1).when(F.col("y") < F.col("centre"), -1)


def _whole(points: DataFrame) -> DataFrame:
    """The one chart of all points, its runs found in pieces of the periods first."""
    points = points.withColumn("centre", points.agg(F.median("y")).scalar())
    useful = points.select("x", _side().alias("side"), piece(points, "x").alias(PIECE)).dropna(subset=["side"])
    inside = Window.partitionBy(PIECE).orderBy("x")
    crossed = F.coalesce(F.col("side") != F.lag("side").over(inside), F.lit(False)).cast("int")
    useful = useful.withColumn("crossed", crossed).withColumn("run", F.sum("crossed").over(inside))
    runs = useful.groupBy(PIECE, "run", "side").agg(F.count("*").alias("length"))
    found = _joined(runs).groupBy("run").agg(F.sum("length").alias("length")).agg(
        F.struct(
            F.coalesce(F.sum("length"), F.lit(0)).cast("int").alias("n_useful"),
            F.coalesce(F.max("length"), F.lit(0)).cast("int").alias("longest_run"),
            F.greatest(F.count("*") - 1, F.lit(0)).cast("int").alias("n_crossings"),
        )
    )
    return points.withColumn("_runs", found.scalar()).select("x", "y", "centre", "_runs.*")


def _faceted(points: DataFrame, facets: Sequence[str]) -> DataFrame:
    """A chart for each facet, which is a window over its points."""
    whole = Window.partitionBy(*facets)
    ordered = whole.orderBy("x")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    crossed = F.coalesce(F.col("side") != F.last("side", ignorenulls=True).over(earlier), F.lit(False))
    return (
        points.withColumn("centre", F.median("y").over(whole))
        .withColumn("side", _side())
        .withColumn("crossed", crossed.cast("int"))
        .withColumn("run", F.sum("crossed").over(ordered))
        .withColumn("run_length", F.count("side").over(Window.partitionBy(*facets, "run")))
        .withColumns(
            {
                "n_useful": F.count("side").over(whole).cast("int"),
                "longest_run": F.max("run_length").over(whole).cast("int"),
                "n_crossings": F.sum("crossed").over(whole).cast("int"),
            }
        )
    )


def run_chart(
    df: DataFrame,
    x: str,
    y: str,
    facet: str | Sequence[str] | None = None,
    agg: str = "sum",
) -> DataFrame:
    """One row per facet and period with the value, the centre line and the signal.

    Each facet is a window over its periods. Without facets, runs are found in pieces of
    the periods, and what crosses from piece to piece then takes one row for each, so that
    a chart of many periods is not sorted in one task.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}, not {agg!r}")
    facets = as_list(facet)
    points = df.filter(F.col(x).isNotNull()).groupBy(*facets, x).agg(AGGREGATES[agg](y).alias("y"))
    points = points.select(*facets, F.col(x).alias("x"), F.col("y").cast("double"))
    chart = _faceted(points, facets) if facets else _whole(points)
    signal = (F.col("longest_run") > F.col("longest_run_max")) | (
        F.col("n_crossings") < F.col("n_crossings_min")
    )
    return chart.join(_limits(chart), "n_useful", "left").select(
        *facets,
        "x",
        "y",
        "centre",
        "n_useful",
        "longest_run",
        "longest_run_max",
        "n_crossings",
        "n_crossings_min",
        F.coalesce(signal, F.lit(False)).alias("signal"),
    )
