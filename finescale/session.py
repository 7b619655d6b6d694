"""Session settings the operators are tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings an operator may rely on; sizes are per-task targets, so they hold at any scale.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply ``SETTINGS`` to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def spread(df: DataFrame) -> DataFrame:
    """Balance a small table over all tasks before each of its rows becomes many.

    A cell or station table fits one file, hence one task; AQE would keep it so. The shuffle moves
    the rows before they multiply, which is cheap next to what follows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``, read again.

    Later jobs then see the same values to the last bit (sums are added up in another order each time) and the planner sees their real
    size. Only a session without that folder, as in tests on one machine, gets its own.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
