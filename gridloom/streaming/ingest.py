"""Arriving files as a stream: each new file's directories, tags or images as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.scan import scan_binary

BINARY_FILE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)


def stream_files(spark: SparkSession, folder: str, mode: str = "ifds", pattern: str = "*.{tif,tiff,TIF,TIFF}", **options: str) -> DataFrame:
    """A streaming relation of the files that appear in ``folder``. Stateless: nothing is held between batches."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(folder)
    return scan_binary(files, mode, **options)


def run_once(df: DataFrame, target: str, checkpoint: str) -> None:
    """Process all files that are there, then stop; a later call continues after them."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
