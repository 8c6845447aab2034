"""Typed readers for the three event tables and the dimension tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.schema import TESTS

MISSING = ("", "NA")


def _clean(column: str, missing: Sequence[str], trim: bool) -> Column:
    col = F.col(f"`{column}`")
    text = F.trim(col) if trim else col
    return F.when(~text.isin(*missing), text) if missing else text


def _typed(text: Column, data_type: T.DataType, decimal: str, date_format: str) -> Column:
    if isinstance(data_type, T.DateType):
        return F.try_to_date(text, date_format)
    if isinstance(data_type, T.NumericType) and decimal == ",":
        text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if isinstance(data_type, T.StringType):
        return text
    return text.try_cast(data_type)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The file and first line with text of a split that begins a file; then the rest is left unread."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("start")[0].as_py():
            return
        filled = pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(batch.column("value")), ""), False)
        found = batch.filter(filled)
        if found.num_rows:
            yield found.slice(0, 1).select(["file", "value"])
            return


def _by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of a path grouped by their first line, in one job.

    Each split is a task of its own here, so that a task stops at the first line of its
    file. A header whose first line ends inside quotes is a group of its own, as the
    lines after it may differ.
    """
    conf, cost = spark.conf, "spark.sql.files.openCostInBytes"
    before = conf.get(cost, None)
    conf.set(cost, conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        lines = spark.read.text(path)
        where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
        found = lines.select("value", *where).mapInArrow(_first_lines, "file string, value string").collect()
    finally:
        conf.unset(cost) if before is None else conf.set(cost, before)
    groups: dict[str, list[str]] = {}
    for row in sorted(found):
        header, file = row["value"], unquote(row["file"])
        groups.setdefault(header + file if header.count('"') % 2 else header, []).append(file)
    return list(groups.values())


def _read_delimited(
    spark: SparkSession, path: str | list[str], sep: str, multiline: bool
) -> DataFrame:
    """All files as text columns, found by name in each file.

    Without inference only the header lines are read here: one job finds those of all
    files, and Spark reads that of one file for each different header. Files are grouped
    by header, since Spark reads a group by the positions of its first file; a column
    that some group lacks is null there. Files without a line hold no rows.
    """
    # The null mark stands in for an unquoted empty field, so that "" stays a text.
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": multiline, "nullValue": "\u0000"}
    reader = spark.read.options(**options)
    groups = _by_header(spark, path)
    if len(groups) < 2:
        return reader.csv(path)
    parts = [reader.csv(group) for group in groups]
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    fmt: str = "csv",
    sep: str = ",",
    decimal: str = ".",
    date_format: str = "yyyy-MM-dd",
    extra: Sequence[str] = (),
    multiline: bool = False,
    missing: Sequence[str] = MISSING,
    trim: bool = True,
) -> DataFrame:
    """Read the columns of ``schema`` by name, plus ``extra`` columns as text.

    ``fmt`` is ``csv``, ``csv2`` (semicolons and decimal commas) or any format
    Spark reads itself, such as ``parquet``. Text that does not fit the type
    becomes null; ``rejected_values`` counts it. Texts in ``missing`` are null, and
    blanks around a value are dropped; ``missing=(), trim=False`` takes back an
    export as it was. ``multiline`` allows line breaks inside quotes; such files
    are read by one task each, others are split.
    """
    if fmt == "csv2":
        fmt, sep, decimal = "csv", ";", ","
    raw = (
        _read_delimited(spark, path, sep, multiline)
        if fmt == "csv"
        else spark.read.format(fmt).load(path)
    )
    absent = [f.name for f in schema if f.name not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    if fmt == "csv":
        typed = [
            _typed(_clean(f.name, missing, trim), f.dataType, decimal, date_format).alias(f.name)
            for f in schema
        ]
        more = [_clean(c, missing, trim).alias(c) for c in extra]
    else:
        typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
        more = [F.col(f"`{c}`").cast("string").alias(c) for c in extra]
    return raw.select(*typed, *more)


def rejected_values(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    decimal: str = ".",
    date_format: str = "yyyy-MM-dd",
    multiline: bool = False,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Per column of a CSV source: values filled in, and how many do not fit the type."""
    raw = _read_delimited(spark, path, sep, multiline)
    texts = {f.name: _clean(f.name, missing, True) for f in schema if f.name in raw.columns}
    typed = {f.name: _typed(texts[f.name], f.dataType, decimal, date_format) for f in schema if f.name in texts}
    counted = raw.agg(
        *(F.count(text).alias(f"{name}:filled") for name, text in texts.items()),
        *(F.count_if(texts[name].isNotNull() & value.isNull()).alias(f"{name}:rejected") for name, value in typed.items()),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"`{name}:filled`").alias("filled"),
                F.col(f"`{name}:rejected`").alias("rejected"),
            )
            for name in texts
        )
    )
    return counted.select(F.inline(rows))


def read_tests(
    spark: SparkSession,
    path: str | list[str],
    agent_cols: Sequence[str] | None = None,
    fmt: str = "csv",
    **options,
) -> DataFrame:
    """Tests with their susceptibility columns: the named ones, or all others."""
    if agent_cols is None:
        sep = ";" if fmt == "csv2" else options.get("sep", ",")
        raw = (
            _read_delimited(spark, path, sep, options.get("multiline", False))
            if fmt in ("csv", "csv2")
            else spark.read.format(fmt).load(path)
        )
        agent_cols = [c for c in raw.columns if c not in TESTS.fieldNames()]
    return read_table(spark, path, TESTS, fmt=fmt, extra=agent_cols, **options)


def read_dim(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "csv", **options
) -> DataFrame:
    """A dimension table; ``with_dim`` decides whether it is small enough to broadcast."""
    return read_table(spark, path, schema, fmt=fmt, **options)


def coerce_dates(df: DataFrame, contains: str = "date", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Turn every text or timestamp column whose name contains ``contains`` into a date."""
    changed = {}
    for field in df.schema:
        if contains.lower() not in field.name.lower():
            continue
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            changed[field.name] = F.try_to_date(col, date_format)
        elif not isinstance(field.dataType, T.DateType):
            changed[field.name] = col.cast("date")
    return df.withColumns(changed) if changed else df
