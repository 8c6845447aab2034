"""Antimicrobial use: defined daily doses (DDD) and days of therapy (DOT) per stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions import total
from wardlens.operators.runchart import run_chart
from wardlens.schema import KEY, check_by

METHODS = ("sum_of_ratios", "pooled")
MEASURES = {"ddd": "ddd_per_day_100", "dot": "dot_per_day_100"}
FACETS = ("specialty", "sub_specialty", "adm_route")
PERIODS = ("year", "yearmonth_adm", "yearquarter_adm")


def _per_admission(rx: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rx.groupBy(*KEY, *keys, "LOS").agg(
        total("ddd_per_prescription").cast("double").alias("ddd_sum"),
        total("ab_days").cast("long").alias("dot_sum"),
    )


def dose_density(
    rx: DataFrame,
    by: str | Sequence[str] | None = None,
    method: str = "sum_of_ratios",
    scale: float = 100.0,
    digits: int | None = None,
) -> DataFrame:
    """DDD and DOT per group in relation to length of stay: ``ddd_100``, ``dot_100``.

    ``sum_of_ratios`` adds dose / LOS over the admissions and divides by
    ``scale``. ``pooled`` is the usual rate, ``scale`` times the dose sum over
    the bed days of the admissions that used the group.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    keys = check_by(by)
    doses = _per_admission(rx, keys)
    if method == "pooled":
        measure = lambda c: F.try_divide(F.sum(c) * F.lit(scale), F.sum("LOS"))
    else:
        measure = lambda c: F.sum(F.try_divide(c, "LOS")) / F.lit(scale)
    wanted = {"ddd_100": measure(F.col("ddd_sum")), "dot_100": measure(F.col("dot_sum"))}
    return doses.groupBy(*keys).agg(
        *((m if digits is None else F.round(m, digits)).alias(name) for name, m in wanted.items())
    )


def dose_per_admission(rx: DataFrame, columns: Sequence[str] = (*PERIODS, *FACETS)) -> DataFrame:
    """Per admission: dose sums, LOS and both ratios, with period and ward columns."""
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col("LOS")) / F.lit(100.0)
    return _per_admission(rx, columns).withColumns(
        {"ddd_per_day_100": ratio("ddd_sum"), "dot_per_day_100": ratio("dot_sum")}
    )


def dose_timeseries(
    rx: DataFrame, measure: str = "ddd", period: str = "yearmonth_adm", facet: str | None = None
) -> DataFrame:
    """Run chart of a dose ratio summed per period, per ward column if asked."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {sorted(MEASURES)}, not {measure!r}")
    check_by(period, PERIODS)
    facets = check_by(facet, FACETS)
    doses = dose_per_admission(rx, [period, *facets])
    return run_chart(doses, x=period, y=MEASURES[measure], facet=facets)
