"""CSV export of cohorts, tests and view tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamped_name(name: str, kind: str, day: dt.date | None = None) -> str:
    """Export name with its kind and the day, such as ``mine_cohort_2020-01-31.csv``."""
    return f"{name}_{kind}_{(day or dt.date.today()).isoformat()}.csv"


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists", na: str = "") -> str:
    """Write a CSV folder with headers, one part per task.

    ``single_file`` asks for one part and suits tables of report size only,
    since one task then writes them. Booleans are written TRUE / FALSE and quotes
    doubled. Missing values are empty and an empty text is ``""``, so that nothing is
    lost: ``read_table(..., missing=(), trim=False)`` takes the export back. ``na``
    names another mark for missing values; a text equal to it then reads as missing.
    """
    out = df.select(
        *(
            F.upper(F.col(f"`{f.name}`").cast("string")).alias(f.name)
            if isinstance(f.dataType, T.BooleanType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )
    if single_file:
        out = out.repartition(1)
    (
        out.write.mode(mode)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("nullValue", na)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .csv(path)
    )
    return path
