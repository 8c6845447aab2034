"""Uptake and timing of diagnostic tests among admissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions import percent_text as as_percent_text
from wardlens.operators.counts import with_share
from wardlens.schema import TIMING_COLUMN, check_by, check_material


def diagnostics_per_period(adm: DataFrame, period: str, proportion: bool = False) -> DataFrame:
    """Admissions per period and check, with the share within the period if asked."""
    keys = check_by(period)
    counts = adm.groupBy(*keys, "check").agg(F.count("*").alias("n"))
    return with_share(counts, within=keys) if proportion else counts


def diagnostic_timing(adm: DataFrame, kind: str) -> DataFrame:
    """Admissions per day between first prescription and first test, by check."""
    timing = TIMING_COLUMN[check_material(kind)]
    return adm.groupBy(timing, "check").agg(F.count("*").alias("n"))


def diagnostic_vs_average(adm: DataFrame, by: str | Sequence[str], digits: int = 1) -> DataFrame:
    """Percentage taken per group, overall, and their difference, highest first."""
    keys = check_by(by)
    groups = adm.groupBy(*keys).agg(
        F.count_if(F.col("check") == "Taken").alias("_taken"), F.count("*").alias("_n")
    )
    overall = groups.agg(F.struct(F.sum("_taken").alias("taken"), F.sum("_n").alias("n"))).scalar()
    percent = lambda taken, n: F.round(F.try_divide(taken * F.lit(100.0), n), digits)
    return (
        groups.withColumn("taken_pct", percent(F.col("_taken"), F.col("_n")))
        .withColumn(
            "overall_pct", percent(overall["taken"], overall["n"])
        )
        .withColumn("difference", F.round(F.col("taken_pct") - F.col("overall_pct"), digits))
        .drop("_taken", "_n")
        .orderBy(F.desc("difference"), *keys)
    )


def diagnostic_table(
    adm: DataFrame, by: str | Sequence[str], digits: int = 1, percent_text: bool = False
) -> DataFrame:
    """Admissions per group and check with their percentage within the group."""
    keys = [c for c in check_by(by) if c != "check"]
    counts = adm.groupBy(*keys, "check").agg(F.count("*").alias("n"))
    percent = F.col("share") * 100.0
    shown = as_percent_text(percent, digits) if percent_text else F.round(percent, digits)
    return with_share(counts, within=keys).withColumn("proportion", shown).drop("share")
