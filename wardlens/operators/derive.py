"""Columns derived row by row: calendar, stay, age, prescription measures, S/I/R."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions import in_range, period_start, sir_value
from wardlens.schema import SIR, TIMING_COLUMN, check_material

SIR_TAG = {"sir": True}


def with_calendar(df: DataFrame, date_col: str, suffix: str, year: str | None = None) -> DataFrame:
    """Add ``yearmonth_<suffix>`` and ``yearquarter_<suffix>``, and a year column if named."""
    added = {
        f"yearmonth_{suffix}": period_start(date_col, "month"),
        f"yearquarter_{suffix}": period_start(date_col, "quarter"),
    }
    if year:
        added[year] = period_start(date_col, "year")
    return df.withColumns(added)


def with_los(
    df: DataFrame, start: str = "adm_start_date", end: str = "adm_end_date", out: str = "LOS"
) -> DataFrame:
    """Length of stay in days, counting the first and the last day."""
    return df.withColumn(out, F.datediff(end, start) + 1)


def with_age(
    df: DataFrame, start: str = "adm_start_date", birth: str = "birth_date", out: str = "age"
) -> DataFrame:
    """Age as the difference of calendar years; birthdays play no part."""
    return df.withColumn(out, F.year(start) - F.year(birth))


def with_rx_measures(df: DataFrame) -> DataFrame:
    """Add ``ab_days`` (0 when stopped the same day), ``ab_timing`` and the dose."""
    days = F.datediff("ab_stop_date", "ab_start_date")
    return df.withColumns(
        {
            "ab_days": days,
            "ab_timing": F.datediff("ab_start_date", "adm_start_date"),
            "ddd_per_prescription": F.col("ddd_per_day") * days,
        }
    )


def with_diagnostic(
    df: DataFrame, kind: str = "blood", lo: int = -1, hi: int = 1, out: str = "check"
) -> DataFrame:
    """``Taken`` if the first test of this kind falls in the day window, else ``Not taken``."""
    timing = TIMING_COLUMN[check_material(kind)]
    first, last = min(lo, hi), max(lo, hi)
    return df.withColumn(
        out, F.when(in_range(timing, first, last), "Taken").otherwise("Not taken")
    )


def with_discharge_event(
    df: DataFrame, death: str = "death_during_adm", out: str = "event"
) -> DataFrame:
    """1 for discharged alive, 0 for died, null where unknown."""
    return df.withColumn(out, (~F.col(death)).cast("int"))


def detect_sir(df: DataFrame, max_invalid: float = 0.05) -> list[str]:
    """Text columns of which at most ``max_invalid`` of the filled values are not S, I or R.

    One aggregation pass over the whole table for all columns together.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    shares = df.agg(
        *(
            F.try_divide(
                F.count(F.nullif(F.trim(f"`{c}`"), F.lit(""))) - F.count(sir_value(f"`{c}`")),
                F.count(F.nullif(F.trim(f"`{c}`"), F.lit(""))),
            ).alias(c)
            for c in texts
        )
    ).first()
    return [c for c in texts if shares[c] is not None and shares[c] <= max_invalid]


def normalize_sir(
    df: DataFrame, cols: Sequence[str] | None = None, max_invalid: float = 0.05
) -> DataFrame:
    """Bring susceptibility columns to S, I, R or null and tag them in the schema."""
    columns = detect_sir(df, max_invalid) if cols is None else list(cols)
    for c in columns:
        df = df.withColumn(c, sir_value(f"`{c}`")).withMetadata(c, SIR_TAG)
    return df


def sir_columns(df: DataFrame) -> list[str]:
    """The susceptibility columns, known by the tag ``normalize_sir`` leaves."""
    return [f.name for f in df.schema if f.metadata.get("sir")]


def sir_profile(df: DataFrame, max_invalid: float = 0.05) -> DataFrame:
    """Per text column: values filled in, values that are S, I or R, their share, and the verdict.

    The verdict is that of ``detect_sir``. One aggregation pass over the table.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counted = df.agg(
        *(F.count(F.nullif(F.trim(f"`{c}`"), F.lit(""))).alias(f"{c}:filled") for c in texts),
        *(F.count(sir_value(f"`{c}`")).alias(f"{c}:valid") for c in texts),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("agent"),
                F.col(f"`{c}:filled`").alias("filled"),
                F.col(f"`{c}:valid`").alias("valid"),
            )
            for c in texts
        )
    )
    share = F.try_divide("valid", "filled")
    return counted.select(F.inline(rows)).select(
        "*", share.alias("share"), F.coalesce(1 - share <= max_invalid, F.lit(False)).alias("is_sir")
    )


def sir_long(df: DataFrame, agents: Sequence[str] | None = None) -> DataFrame:
    """One row per test and agent with a result: columns ``agent``, ``interpretation``."""
    agents = sir_columns(df) if agents is None else list(agents)
    tagged = set(sir_columns(df)) | set(agents)
    ids = [c for c in df.columns if c not in tagged]
    long = df.unpivot(ids, agents, "agent", "interpretation")
    return long.filter(F.col("interpretation").isin(*SIR))
