"""Counts, shares, domains and the admission grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.schema import KEY, PRESCRIPTION_COLUMNS, as_list

# Order of the prescriptions of an admission; the first one speaks for it.
FIRST_BY = ("ab_start_date", "ab_stop_date", "atc_code", "ab_route")


def admission_grain(cohort: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per admission, with the prescription columns of its first prescription.

    First is by start, stop, agent code and route, then by the prescription
    columns asked for. ``columns`` limits the result to what a view needs, which
    keeps scan and shuffle narrow; None keeps all.
    """
    wanted = [c for c in (cohort.columns if columns is None else as_list(columns)) if c not in KEY]
    own = [c for c in wanted if c in PRESCRIPTION_COLUMNS]
    fixed = [c for c in wanted if c not in PRESCRIPTION_COLUMNS]
    if not own:
        return cohort.select(*KEY, *wanted).distinct()
    order = [c for c in FIRST_BY if c in cohort.columns]
    rest = [c for c in own if c not in order]
    first = cohort.groupBy(*KEY, *fixed).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(
        *KEY, *(F.col(f"_first.{c}").alias(c) if c in own else F.col(c) for c in wanted)
    )


def admission_total(cohort: DataFrame) -> DataFrame:
    """Number of admissions in the cohort, one row."""
    return cohort.agg(F.countDistinct(*KEY).alias("n"))


def count_by(df: DataFrame, by: str | Sequence[str], top: int | None = None) -> DataFrame:
    """Rows per group, most frequent first; ties by group."""
    keys = as_list(by)
    ordered = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return ordered if top is None else ordered.limit(top)


def order_by(df: DataFrame, desc: Sequence[str] = (), asc: Sequence[str] = ()) -> DataFrame:
    """Sort a result by descending, then ascending columns."""
    return df.orderBy(*(F.desc(c) for c in as_list(desc)), *as_list(asc))


def with_share(
    counts: DataFrame, n: str = "n", within: str | Sequence[str] | None = None, out: str = "share"
) -> DataFrame:
    """Add the share of ``n`` within its group, or of the total, on a table of counts."""
    groups = as_list(within)
    # The total is one row, which a window over all rows would gather in one task.
    whole = F.sum(n).over(Window.partitionBy(*groups)) if groups else counts.agg(F.sum(n)).scalar()
    return counts.withColumn(out, F.try_divide(F.col(n).cast("double"), whole))


def agent_domain(rx: DataFrame) -> DataFrame:
    """Known agents by number of prescriptions."""
    return count_by(rx.filter(F.col("ab_type").isNotNull()), "ab_type")


def distinct_values(df: DataFrame, *columns: str, sort: bool = False, nulls: bool = True) -> DataFrame:
    """Distinct combinations, sorted on request, without null values on request."""
    values = df.select(*columns)
    values = (values if nulls else values.dropna()).distinct()
    return values.orderBy(*columns) if sort else values


def selector_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per number column: ``selector``, ``lowest``, ``highest``."""
    ends = df.agg(
        *(F.min(c).cast("int").alias(f"{c}:lo") for c in columns),
        *(F.max(c).cast("int").alias(f"{c}:hi") for c in columns),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("selector"),
                F.col(f"`{c}:lo`").alias("lowest"),
                F.col(f"`{c}:hi`").alias("highest"),
            )
            for c in columns
        )
    )
    return ends.select(F.inline(rows))


def selector_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct known values per text column: ``selector``, ``choice``, in one pass."""
    long = df.select(*(F.col(c).cast("string") for c in columns)).unpivot(
        [], list(columns), "selector", "choice"
    )
    return long.filter(F.col("choice").isNotNull()).distinct()


def n_groups(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Number of distinct groups, one row; a null group counts like any other."""
    return df.agg(F.countDistinct(F.struct(*as_list(by))).alias("n"))


def relabel(df: DataFrame, labels: dict[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """Rename columns for display and, if an order is given, keep and order these."""
    renamed = df.withColumnsRenamed(labels)
    return renamed if order is None else renamed.select(*order)
