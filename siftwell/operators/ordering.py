"""Numbers and running sums over a whole table, of which no task sees more than a part."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named in spark.checkpoint.dir. Where none is named, a session within one process gets one; a
    cluster's executors share no local folder, so there the setting has to be given."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"/tmp/siftwell-checkpoints-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that every task may hold.
_HELD = 50_000


def met(df: DataFrame) -> DataFrame:
    """settled(df) for joins with larger tables: sent to every task if it has few rows, else merged. File sizes tell little
    of that, as paths and names repeat and compress well. Rows are dealt anew first, so that a merge does
    not rely on how a checkpoint says that they are dealt."""
    out = settled(df.hint("rebalance"))
    return F.broadcast(out) if out.limit(_HELD + 1).count() <= _HELD else merged(out)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the corpus, as the other does: no task and no driver holds it whole, whatever
    the sizes of its compressed files say."""
    return df.hint("merge")


def running_sums(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with sums over all rows up to each, by the order columns, which should be total: for each value column the
    name of its sum. The table is cut into ordered parts and written down once, so that parts stay what they are; a part's
    rows then start from the sums of the parts before, which is a table of a row a part."""
    ensure_checkpoint_dir(df.sparkSession)
    part, before = "__part", {v: f"__before{k}" for k, v in enumerate(values)}
    cut = df.orderBy(*order).checkpoint().withColumn(part, F.spark_partition_id())
    sums = cut.groupBy(part).agg(*(F.sum(v).alias(before[v]) for v in values))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sums.select(part, *(F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before.values()))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = cut.withColumns({out: F.sum(v).over(within) for v, out in values.items()}).join(F.broadcast(starts), part)
    return ran.withColumns({out: F.col(out) + F.col(before[v]) for v, out in values.items()}).drop(part, *before.values())


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over all rows up to each, see running_sums."""
    return running_sums(df, order, {value: out})


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the place of each row from 0."""
    return running_sum(df.withColumn("__one", F.lit(1)), order, "__one", out).withColumn(out, (F.col(out) - 1).cast("long")).drop("__one")
