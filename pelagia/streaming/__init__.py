"""Exports as they arrive: interval files of a running survey, summed by transect.

A file that lands in the folder is read once; the state is one row per transect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelagia.sources.surveys import export_columns, file_name


def export_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.csv", pattern: str = r"T(\d+)") -> DataFrame:
    """Rows of all export files of a folder, present and to come, with canonical columns and the transect of the file's name."""
    raw = spark.readStream.options(header=True, ignoreLeadingWhiteSpace=True, enforceSchema=False, pathGlobFilter=glob).schema(schema).csv(folder)
    df = export_columns(raw.withColumn("filename", file_name()))
    return df.withColumn("transect_num", F.regexp_extract("filename", pattern, 1).cast("double"))


def transect_totals(stream: DataFrame, value: str = "nasc") -> DataFrame:
    """Running sums, counts and extents by transect."""
    return stream.groupBy("transect_num").agg(F.sum(value).alias(value), F.count("*").alias("intervals"), F.min("distance_s").alias("distance_s"), F.max("distance_e").alias("distance_e"))


def keep_totals(totals: DataFrame, path: str, checkpoint: str, kept: int = 2) -> StreamingQuery:
    """Write the totals after each batch as a Parquet table of its own below ``path``; ends when all files there are are read.

    A reader has the newest whole table (``read_totals``), also while the next is
    written or after a failure in between. The last ``kept`` tables stay. A batch
    that is run again writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in sorted(whole_batches(batch.sparkSession, path))[:-kept]:
            folder = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(path, f"batch={old}")
            file_system(batch.sparkSession, folder).delete(folder, True)

    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def file_system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below ``path`` whose tables are complete."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS")
    found = file_system(spark, done).globStatus(done) or []
    return [int(f.getPath().getParent().getName().partition("=")[2]) for f in found]


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete totals below ``path``; FileNotFoundError before there are any."""
    numbers = whole_batches(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no complete totals in '{path}'")
    return spark.read.parquet(f"{path}/batch={max(numbers)}")
