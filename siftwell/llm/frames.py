"""Small helpers on DataFrames that several operators share."""

from __future__ import annotations

import gc
import math
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of columns made inside an operator, so that input columns of any usual name pass through.
OWN = "__sw_"


def own(name: str) -> str:
    return OWN + name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named in spark.checkpoint.dir. Where none is named, a session within one process gets one; a
    cluster's executors share no local folder, so there the setting has to be given."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"/tmp/siftwell-checkpoints-{uuid.uuid4().hex}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets go of frames that are no longer referenced, so that Spark deletes their shuffle files and checkpoints now,
    and not when the driver's memory happens to fill. For a few points between long steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.select(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: float, each: float) -> int:
    return max(1, math.ceil(total / each))


def gapless(df: DataFrame, group: str, order: list[str], out: str, rows: int) -> DataFrame:
    """Numbers the rows of every group from 0 without gaps, though no task sees a whole group.

    A group's rows are dealt over hash buckets of the order columns; a bucket's rows are numbered in that order,
    beginning after all rows of the group's earlier buckets. Rows equal in all order columns are interchangeable.
    Of n rows a bucket holds the root, 1000 at least, so the counts table, with a row for each group and bucket, stays
    as small as a bucket.
    """
    each = max(1000, math.isqrt(rows))
    bucket, before, size, within = own("bucket"), own("before"), own("size"), own("within")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(pieces(rows, each))).cast("int"))
    counts = dealt.groupBy(group, bucket).agg(F.count("*").alias(size))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, bucket, F.coalesce(F.sum(size).over(ahead), F.lit(0)).alias(before))
    numbered = dealt.withColumn(within, F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)) - 1)
    return numbered.join(counts, [group, bucket]).withColumn(out, (F.col(before) + F.col(within)).cast("long")).drop(bucket, before, within)


@contextmanager
def written(df: DataFrame, name: str):
    """df as a Parquet table in the shared folder, read again. The table goes when the block ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        delete_folder(spark, path)
