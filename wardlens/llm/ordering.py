"""Rows in ascending order of a key, in buckets that one task each goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, where that makes more buckets than the session has shuffle partitions.
ROWS_PER_BUCKET = 20_000


def buckets(rows: DataFrame, key: str) -> tuple[Column, int]:
    """The bucket of a row, ascending with the key (null: 0), and how many there are.

    The cuts are approximate quantiles of the key, so a bucket holds about as many rows as
    any other unless one key holds more.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = rows.count()
    wanted = max(1, min(max(wanted, count // ROWS_PER_BUCKET), count))
    shares = [k / wanted for k in range(1, wanted)]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, shares, 100 * wanted)).first()[0] or [])) if shares else []
    if not cuts:
        return F.lit(0), 1
    below = F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(key))
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(below)), len(cuts) + 1


def dealt(rows: DataFrame, count: int, *order: str) -> DataFrame:
    """Each bucket in a partition of its own, its rows in order."""
    return rows.repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", *order)
