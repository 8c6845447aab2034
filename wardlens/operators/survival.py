"""Kaplan-Meier curves and the log-rank test on length of stay."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import in_range
from wardlens.operators.prefix import with_running_sums
from wardlens.schema import as_list

MAX_STRATA = 5


def _complete(adm: DataFrame, *columns: str) -> DataFrame:
    return adm.dropna(subset=list(columns))


def km_curve(
    adm: DataFrame,
    time: str = "LOS",
    event: str = "event",
    strata: str | Sequence[str] | None = None,
    xlim: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """Kaplan-Meier estimate per stratum and time.

    ``event`` is 1 or, for censored, 0. Rows with an unknown time, event or
    stratum are left out. Sums over time run on one row per stratum and time; without
    strata in two levels, so that a curve of many times is not sorted in one task.
    """
    keys = as_list(strata)
    risk = (
        _complete(adm, time, event, *keys)
        .groupBy(*keys, F.col(time).alias("time"))
        .agg(F.sum(F.col(event).cast("long")).alias("n_event"), F.count("*").alias("_left"))
    )
    at_risk = with_running_sums(risk, keys, "time", backward={"n_risk": "_left"})
    stayed = 1 - F.col("n_event") / F.col("n_risk")
    steps = at_risk.withColumn("_stayed", stayed).withColumns(
        {
            "_step": F.log(F.when(F.col("_stayed") > 0, F.col("_stayed"))),
            "_end": (F.col("_stayed") <= 0).cast("int"),
        }
    )
    sums = with_running_sums(steps, keys, "time", forward={"_log": "_step", "_ends": "_end"})
    curve = sums.select(
        *keys,
        "time",
        "n_risk",
        "n_event",
        (F.col("_left") - F.col("n_event")).alias("n_censor"),
        F.when(F.col("_ends") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"),
    )
    shown = in_range("time", *xlim)
    return curve if shown is None else curve.filter(shown)


def strata_values(adm: DataFrame, strata: str, max_strata: int | None = MAX_STRATA) -> list:
    """The known strata in order; raises unless there are two to ``max_strata`` (None: any number)."""
    distinct = adm.select(strata).dropna().distinct()
    found = (distinct if max_strata is None else distinct.limit(max_strata + 1)).collect()
    if len(found) < 2:
        raise ValueError("choose a column with at least two groups")
    if max_strata is not None and len(found) > max_strata:
        raise ValueError(f"at most {max_strata} groups can be compared; adjust the selection")
    return sorted(row[0] for row in found)


def _counts(adm: DataFrame, time: str, event: str, strata: str) -> DataFrame:
    """Admissions ``m`` and events ``d`` per time ``t`` and stratum."""
    return (
        _complete(adm, time, event, strata)
        .groupBy(F.col(time).alias("t"), strata)
        .agg(F.count("*").alias("m"), F.sum(F.col(event).cast("long")).alias("d"))
    )


def _sums(counts: DataFrame, strata: str, values: list) -> DataFrame:
    """One row with O, E per stratum (``o0``, ``e0``) and the covariances (``v0_1``)."""
    size = range(len(values))
    is_in = [F.col(strata) == F.lit(v) for v in values]
    at_time = counts.groupBy("t").agg(
        *(F.sum(F.when(is_in[i], F.col("d")).otherwise(0)).alias(f"d{i}") for i in size),
        *(F.sum(F.when(is_in[i], F.col("m")).otherwise(0)).alias(f"m{i}") for i in size),
    )
    risk = with_running_sums(at_time, [], "t", backward={f"n{i}": f"m{i}" for i in size})
    d: Column = sum((F.col(f"d{i}") for i in size), F.lit(0))
    n: Column = sum((F.col(f"n{i}") for i in size), F.lit(0))
    risk = risk.withColumns({"d": d.cast("double"), "n": n.cast("double")})
    spread = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1))
    share = [F.col(f"n{i}") / F.col("n") for i in size]
    return risk.agg(
        *(F.sum(f"d{i}").alias(f"o{i}") for i in size),
        *(F.sum(f"m{i}").alias(f"c{i}") for i in size),
        *(F.sum(F.col("d") * share[i]).alias(f"e{i}") for i in size),
        *(
            F.coalesce(
                F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])), F.lit(0.0)
            ).alias(f"v{i}_{j}")
            for i in size
            for j in size
            if i <= j
        ),
    )


def logrank_table(
    adm: DataFrame,
    time: str = "LOS",
    event: str = "event",
    strata: str = "check",
    max_strata: int | None = MAX_STRATA,
) -> DataFrame:
    """Per stratum: number, observed and expected events, variance of their difference."""
    values = strata_values(adm, strata, max_strata)
    rows = F.array(
        *(
            F.struct(
                F.lit(v).alias(strata),
                F.col(f"c{i}").alias("n"),
                F.col(f"o{i}").alias("observed"),
                F.col(f"e{i}").alias("expected"),
                F.col(f"v{i}_{i}").alias("variance"),
            )
            for i, v in enumerate(values)
        )
    )
    return _sums(_counts(adm, time, event, strata), strata, values).select(F.inline(rows))


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), a finite sum for each df."""
    if df < 1:
        raise ValueError("at least one degree of freedom")
    if x <= 0:
        return 1.0
    # Two more degrees of freedom add (x / 2) ** (k / 2) * exp(-x / 2) / gamma(k / 2 + 1).
    odd = df % 2
    tail = math.erfc(math.sqrt(x / 2)) if odd else math.exp(-x / 2)
    for k in range(1 if odd else 2, df, 2):
        tail += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    return min(tail, 1.0)


def logrank_test(
    adm: DataFrame,
    time: str = "LOS",
    event: str = "event",
    strata: str = "check",
    max_strata: int | None = MAX_STRATA,
) -> DataFrame:
    """One row: ``chisq``, ``df`` and ``p_value`` of equal curves in the strata.

    Spark counts the admissions per time and stratum, once; the strata and the one row
    of sums come from these counts, and only a system as large as the strata are many
    is solved on the driver.
    """
    adm = _counts(adm, time, event, strata)
    values = strata_values(adm, strata, max_strata)
    sums = _sums(adm, strata, values).first()
    df = len(values) - 1
    difference = np.array([sums[f"o{i}"] - sums[f"e{i}"] for i in range(df)])
    spread = np.array([[sums[f"v{min(i, j)}_{max(i, j)}"] for j in range(df)] for i in range(df)])
    chisq = float(difference @ np.linalg.pinv(spread) @ difference)
    return adm.sparkSession.createDataFrame(
        [(chisq, df, chi_square_tail(chisq, df))], "chisq double, df int, p_value double"
    )
