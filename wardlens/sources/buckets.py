"""Tables kept in buckets of a key, so that joins and groups by the key need no shuffle.

A bucketed table is Parquet below a path, one file for each bucket, and an entry of the
session's catalog that tells Spark how the rows are dealt. Another session makes that
entry anew from the layout written beside the files. Tables of one key and one number of
buckets meet where they lie.

All rows of one key are in one bucket. The key should be one whose rows are bounded, like
an admission, and not one that may hold a large share of all rows, like a patient.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wardlens.session import PARTITIONS


def _name(path: str) -> str:
    return "wardlens_" + hashlib.md5(path.encode()).hexdigest()


def _layout(path: str) -> str:
    return f"{path}-layout"


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as the session's shuffles have partitions, or begin with (see ``configure``)."""
    return int(spark.conf.get(PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    buckets: int | None = None,
    mode: str = "errorifexists",
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Write a table in buckets of the keys and read it from there.

    Rows are dealt to the buckets by one shuffle before they are written, so that a
    bucket is one file, or with ``partitions`` one in the folder of each of their values;
    another session then reads the files as they are. Rows that come in as many buckets of
    the keys stay where they are.
    """
    spark = df.sparkSession
    number = buckets or default_buckets(spark)
    keys = list(keys)
    dealt = df.repartition(number, *keys).write.format("parquet").mode(mode)
    if partitions:
        dealt = dealt.partitionBy(*partitions)
    dealt.bucketBy(number, *keys).option("path", path).saveAsTable(_name(path))
    if partitions:
        return spark.table(_name(path))
    layout = spark.createDataFrame([(keys, number, df.schema.json())], "keys array<string>, buckets int, schema string")
    layout.coalesce(1).write.mode(mode).parquet(_layout(path))
    return spark.table(_name(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed table below a path, in this or a later session."""
    if not spark.catalog.tableExists(_name(path)):
        layout = spark.read.parquet(_layout(path)).first()
        fields = StructType.fromJson(json.loads(layout["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(f"`{key}`" for key in layout["keys"])
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(_name(path))
