"""Exact duplicates: combine copies inside each task, then by salted digest, then once for all.

Texts are equal if they are identical after A-Z became a-z; null counts as empty. Rows
are grouped by digest and whole text in three steps, so that a digest never stands for a
comparison: copies of one task are combined where they are read, the salted groups of a
digest merge in up to ``SALTS`` places, and one row for each of these meets the others. A
text held by a third of all rows therefore arrives as a handful of rows.

The way back is by digest alone, as ids and digests are all that travels. Digests that
stand for more than one text are looked up by text. Groups with more than one row in
``HOT`` of the table, which are fewer than ``HOT``, are broadcast; the others meet their
rows in a shuffle, in which the rows of broadcast groups are spread by id.

Null and empty texts are one group. Of rows that repeat id and text, one is kept; null
ids are smaller than all others, and a group of null ids has a null ``keep``. Very long
texts are grouped whole. An empty table gives an empty one. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.session import scratch_path

SALTS = 16
HOT = 1000
#: Repeated rows of one id and text travel as one row with their number for each so many.
PIECE = 4096


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def merged(named: DataFrame) -> DataFrame:
    """digest, text, keep (the largest key) and size of each group of equal texts."""
    salted = named.withColumn("salt", F.spark_partition_id() % SALTS)
    local = salted.groupBy("digest", "text", "salt").agg(F.max("key").alias("keep"), F.count("*").alias("size"))
    return local.groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))


def _counted(named: DataFrame, *by: str) -> DataFrame:
    """The rows of one key and digest as one row for each ``PIECE`` copies."""
    copies = named.groupBy("key", *by).agg(F.count("*").alias("copies"))
    return copies.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {PIECE})")))


def _each(pieces: DataFrame) -> DataFrame:
    """A row for each copy; the first copy of the row that stays is kept."""
    copy = F.explode(F.expr(f"sequence(1L, least({PIECE}, copies - piece * {PIECE}))"))
    kept = F.col("key").eqNullSafe(F.col("keep")) & (F.col("piece") == 0) & (F.col("copy") == 1)
    return pieces.withColumn("copy", copy).select("key", "keep", "size", kept.alias("kept"), "digest")


def members(rows: DataFrame, key: str, text: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """key, keep, size, kept and digest (of the lowered text) of every row."""
    spark = rows.sparkSession
    named = rows.select(F.col(key).alias("key"), lowered(F.col(text)).alias("text")).withColumn("digest", digest(F.col("text")))
    path = scratch_path(spark, "exact")
    merged(named).select("digest", "keep", "size").write.parquet(path)
    texts = F.count("*").alias("texts")
    groups = spark.read.parquet(path).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("size").alias("size"), texts)
    total, mixed = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("texts") > 1, 1))).first()
    sole = groups.where("texts = 1").drop("texts")
    often = F.col("size") * HOT > total
    hot = F.broadcast(sole.where(often).select("digest", F.col("keep").alias("hot_keep"), F.col("size").alias("hot_size")))
    found = _counted(named.drop("text"), "digest").join(hot, "digest", "left")
    apart = F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("-"), F.col("piece").cast("string"))
    found = found.withColumn("way", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(apart))
    found = found.join(sole.where(~often).withColumnRenamed("digest", "way"), "way", "left")
    own = found.where(F.coalesce("hot_size", "size").isNotNull()).select(
        "key", "digest", "copies", "piece",
        F.when(F.col("hot_size").isNull(), F.col("keep")).otherwise(F.col("hot_keep")).alias("keep"),
        F.coalesce("hot_size", "size").alias("size"),
    )
    if mixed:
        several = named.join(groups.where("texts > 1").select("digest"), "digest", "left_semi")
        own = own.unionByName(_counted(several, "digest", "text").join(merged(several), ["digest", "text"]).drop("text"))
    return _each(own)
