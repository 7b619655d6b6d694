"""Tables in the folder that the cluster shares, and the split of learning rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session without one, as in tests on one machine, gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` whose last reader has run: none may be part of a frame that is still to be computed."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (null without an id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where the remainder is 2; such rows teach nothing. A row without an id counts as held out of learning elsewhere
    (``learnable``), but not as held out here."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) != 2, F.lit(False))
