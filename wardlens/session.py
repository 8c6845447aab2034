"""Session settings the operators are designed for, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Adaptive execution sizes the shuffles, splits hot join keys and turns joins
# with a measured small side into broadcasts. Splitting is worth one more
# shuffle, hence the force flag.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A copy of a bucketed table keeps its buckets instead of cutting each into many files.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}
# Shuffles start with this many partitions and are merged from there by adaptive execution.
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Bytes of the sources' files for each of them, about ten times that in a task's memory.
PARTITION_BYTES = 8_000_000


def configure(spark: SparkSession, sources: Sequence[str] = ()) -> SparkSession:
    """Apply the run-time settings to an existing session.

    Given the paths of the sources (patterns, too), shuffles and buckets are as many as
    their files have bytes for, and no fewer than the session's shuffle partitions: what a
    task holds then does not grow with the input.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if sources:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(sources))
        size = files.agg(F.sum("length")).first()[0] or 0
        wanted = -(-size // PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(PARTITIONS, str(wanted))
        else:
            spark.conf.unset(PARTITIONS)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir``, or None."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
