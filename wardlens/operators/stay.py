"""Length of stay: histogram, density and summary.

All of them first count admissions per group and day, so what follows works on
as many rows as there are lengths of stay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions import in_range
from wardlens.functions import percent_text as as_percent_text
from wardlens.operators.counts import with_share
from wardlens.schema import check_by


def los_histogram(
    adm: DataFrame,
    by: str | Sequence[str] | None = None,
    zoom: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """Admissions per group and day of stay, within the zoom range."""
    shown = in_range("LOS", *zoom)
    rows = adm.filter(F.col("LOS").isNotNull())
    rows = rows if shown is None else rows.filter(shown)
    return rows.groupBy(*check_by(by), "LOS").agg(F.count("*").alias("n"))


def shared_bandwidth(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The histogram with ``_bw``: the mean over groups of each group's rule-of-thumb width.

    The rule (Silverman 1986) is 0.9 * min(sd, IQR / 1.34) * n ** -0.2 for groups
    of at least two; sd alone if the IQR is 0, and the value itself, or 1, in
    place of an sd of 0.
    """
    group = Window.partitionBy(*keys)
    size = F.sum("n").over(group)
    mean = F.sum(F.col("LOS") * F.col("n")).over(group) / size
    rows = histogram.withColumns({"_size": size, "_mean": mean})
    spread = F.sum((F.col("LOS") - F.col("_mean")) ** 2 * F.col("n"))
    stats = rows.groupBy(*keys, "_size", "_mean").agg(
        F.sqrt(F.try_divide(spread, F.col("_size") - 1)).alias("_sd"),
        F.percentile("LOS", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("_q"),
    )
    iqr = (F.col("_q")[1] - F.col("_q")[0]) / 1.34
    scale = F.when(F.col("_sd") > 0, F.least("_sd", F.when(iqr > 0, iqr))).otherwise(
        F.when(F.col("_mean") != 0, F.abs("_mean")).otherwise(1.0)
    )
    width = scale * 0.9 * F.col("_size") ** -0.2
    stats = stats.withColumn("_own", F.when(F.col("_size") > 1, width))
    stats = stats.withColumn("_bw", stats.agg(F.avg("_own")).scalar())
    s, h = stats.alias("s"), histogram.alias("h")
    if not keys:
        return histogram.withColumn("_bw", F.lit(stats.first()["_bw"]))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return h.join(s, same).select("h.*", "s._bw")


def los_density(
    adm: DataFrame,
    by: str | Sequence[str] | None = None,
    grid: tuple[float, float, float] = (0, 60, 1),
    bw: float | str = 1.0,
) -> DataFrame:
    """Gaussian kernel density of LOS per group on the grid (from, to, step).

    ``bw="shared"`` takes one width for all groups, see ``shared_bandwidth``.
    """
    keys = check_by(by)
    histogram = los_histogram(adm, keys)
    if bw == "shared":
        histogram = shared_bandwidth(histogram, keys)
    else:
        histogram = histogram.withColumn("_bw", F.lit(float(bw)))
    low, high, step = grid
    steps = F.sequence(F.lit(0), F.lit(int(math.floor((high - low) / step + 1e-9))))
    at = F.lit(float(low)) + F.col("_step") * F.lit(float(step))
    z = (F.col("x") - F.col("LOS")) / F.col("_bw")
    kernel = F.exp(z * z * -0.5) * F.col("n") / (F.col("_bw") * math.sqrt(2 * math.pi))
    return (
        histogram.withColumn("_step", F.explode(steps))
        .withColumn("x", at)
        .groupBy(*keys, "x")
        .agg((F.sum(kernel) / F.sum("n")).alias("density"))
    )


def los_ridges(
    adm: DataFrame, by: str | Sequence[str], grid: tuple[float, float, float] = (0, 60, 1)
) -> DataFrame:
    """Density per group with the bandwidth shared over the groups."""
    return los_density(adm, by, grid, bw="shared")


def los_summary(
    adm: DataFrame,
    by: str | Sequence[str] | None = None,
    digits: int = 1,
    percent_text: bool = False,
) -> DataFrame:
    """Mean, median, quartiles, number and percentage of all admissions per group.

    Unknown stays count in ``n`` and ``n_missing`` but not in the statistics.
    """
    keys = check_by(by)
    histogram = adm.groupBy(*keys, "LOS").agg(F.count("*").alias("n"))
    known = F.when(F.col("LOS").isNotNull(), F.col("n"))
    quartiles = F.percentile("LOS", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    table = histogram.groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(F.col("LOS") * F.col("n")), F.sum(known)), digits).alias("mean_los"),
        quartiles.alias("_q"),
        F.sum("n").alias("n"),
        (F.sum("n") - F.coalesce(F.sum(known), F.lit(0))).alias("n_missing"),
    )
    percent = F.col("share") * 100.0
    shown = as_percent_text(percent, digits, space=True) if percent_text else F.round(percent, digits)
    return with_share(table).select(
        *keys,
        "mean_los",
        F.round(F.col("_q")[1], digits).alias("median_los"),
        F.round(F.col("_q")[0], digits).alias("q1"),
        F.round(F.col("_q")[2], digits).alias("q3"),
        "n",
        "n_missing",
        shown.alias("proportion"),
    )
