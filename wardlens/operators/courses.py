"""Treatment courses: runs of prescriptions without a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.schema import KEY


def _per_start_day(rx: DataFrame, start: str, stop: str, by: Sequence[str]) -> DataFrame:
    """One row per start day with the first and last stop.

    The windows of this module run on these rows, of which a group has at most
    one per calendar day, however many prescriptions there are.
    """
    return (
        rx.dropna(subset=[start, stop])
        .groupBy(*by, F.col(start).alias("_start"))
        .agg(F.min(stop).alias("_first_stop"), F.max(stop).alias("_last_stop"))
    )


def first_course(
    rx: DataFrame,
    start: str = "ab_start_date",
    stop: str = "ab_stop_date",
    by: Sequence[str] = tuple(KEY),
) -> DataFrame:
    """The leading run in which each prescription starts by the stop of the one before.

    Prescriptions are taken in order of start and stop and compared with the
    one directly before, so starting on the day after it already is a gap.
    Gives ``ab_start_cont``, ``ab_stop_cont`` and ``ab_days_all``, which counts
    both end days.
    """
    ordered = Window.partitionBy(*by).orderBy("_start")
    # A stop before its own start makes the next row of the same day a gap, so
    # only that first row can belong to the run.
    days = _per_start_day(rx, start, stop, by).withColumn(
        "_stop",
        F.when(F.col("_first_stop") < F.col("_start"), F.col("_first_stop")).otherwise(
            F.col("_last_stop")
        ),
    )
    gap = F.coalesce(F.col("_start") > F.lag("_stop").over(ordered), F.lit(False))
    return (
        days.withColumn("_gap", gap)
        .withColumn("_cut", F.max("_gap").over(ordered))
        .filter(~F.col("_cut"))
        .groupBy(*by)
        .agg(F.min("_start").alias("ab_start_cont"), F.max("_stop").alias("ab_stop_cont"))
        .withColumn("ab_days_all", F.datediff("ab_stop_cont", "ab_start_cont") + 1)
    )


def all_courses(
    rx: DataFrame,
    tolerance: int = 0,
    start: str = "ab_start_date",
    stop: str = "ab_stop_date",
    by: Sequence[str] = tuple(KEY),
) -> DataFrame:
    """Every course, numbered; a gap is more than ``tolerance`` days after all stops so far."""
    ordered = Window.partitionBy(*by).orderBy("_start")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    days = _per_start_day(rx, start, stop, by).withColumn(
        "_open_until", F.max("_last_stop").over(before)
    )
    new = F.coalesce(F.datediff("_start", "_open_until") > tolerance, F.lit(True))
    return (
        days.withColumn("course", F.sum(new.cast("int")).over(ordered).cast("int"))
        .groupBy(*by, "course")
        .agg(F.min("_start").alias("course_start"), F.max("_last_stop").alias("course_stop"))
        .withColumn("course_days", F.datediff("course_stop", "course_start") + 1)
    )


def with_course(rx: DataFrame) -> DataFrame:
    """Add the admission's first course to every prescription."""
    return rx.join(first_course(rx), KEY, "left")
