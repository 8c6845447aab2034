"""Table schemas, column roles and the grouping columns the views accept."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

KEY = ["id", "adm_id"]

ADMISSIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("adm_id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("adm_start_date", T.DateType()),
        T.StructField("adm_end_date", T.DateType()),
        T.StructField("death_during_adm", T.BooleanType()),
        T.StructField("adm_route", T.StringType()),
        T.StructField("sub_specialty", T.StringType()),
        T.StructField("specialty", T.StringType()),
        T.StructField("birth_date", T.DateType()),
    ]
)

PRESCRIPTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ab_start_date", T.DateType()),
        T.StructField("ab_stop_date", T.DateType()),
        T.StructField("ab_route", T.StringType()),
        T.StructField("atc_code", T.StringType()),
        T.StructField("ddd_per_day", T.DoubleType()),
    ]
)

# The susceptibility columns come on top of these and differ per laboratory.
TESTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("specialty", T.StringType()),
        T.StructField("mo", T.StringType()),
        T.StructField("material", T.StringType()),
        T.StructField("test_date", T.DateType()),
        T.StructField("test_number", T.StringType()),
    ]
)

AGENTS = T.StructType(
    [
        T.StructField("atc_code", T.StringType()),
        T.StructField("ab_type", T.StringType()),
        T.StructField("ab_group", T.StringType()),
    ]
)

ORGANISMS = T.StructType(
    [
        T.StructField("mo", T.StringType()),
        T.StructField("fullname", T.StringType()),
        T.StructField("family", T.StringType()),
    ]
)

AGENT_NAMES = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("agent_name", T.StringType()),
    ]
)

# Columns that differ between the prescriptions of one admission; every other
# column of an enriched prescription belongs to its admission.
PRESCRIPTION_COLUMNS = (
    "ab_start_date",
    "ab_stop_date",
    "atc_code",
    "ab_route",
    "ddd_per_day",
    "ab_days",
    "ab_timing",
    "ddd_per_prescription",
    "ab_type",
    "ab_group",
    "ab_first",
)

BY_VALUES = (
    "specialty",
    "sub_specialty",
    "adm_route",
    "gender",
    "year",
    "yearmonth_adm",
    "yearquarter_adm",
    "yearmonth_test",
    "yearquarter_test",
    "ab_group",
    "ab_type",
    "check",
    "fullname",
)

SIR = ("S", "I", "R")
MATERIALS = ("blood", "urine")
TIMING_COLUMN = {"blood": "bc_timing", "urine": "uc_timing"}


def as_list(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def check_by(by: str | Sequence[str] | None, allowed: Iterable[str] = BY_VALUES) -> list[str]:
    """Grouping columns as a list; raises on one the views do not offer."""
    columns = as_list(by)
    unknown = [c for c in columns if c not in set(allowed)]
    if unknown:
        raise ValueError(f"cannot group by {unknown}; choose from {sorted(allowed)}")
    return columns


def check_material(material: str) -> str:
    if material not in MATERIALS:
        raise ValueError(f"material must be one of {MATERIALS}, not {material!r}")
    return material
