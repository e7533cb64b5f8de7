"""Shared helpers of the corpus operators: tables in the shared folder, words, small constants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Only where neither that setting nor a checkpoint folder is there, as in tests, a local one is made and set.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(base)  # named in full, as Python readers don't know Hadoop's default store
    base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: the lineage ends at the shared folder.

    The plan never runs again, so Spark may drop its shuffle files as soon as the write has ended.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

