"""Cutting the lineage of iterative operators through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folder(context) -> str:
    """The folder that spark.checkpoint.dir names; a local master gets a temporary one."""
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint."""
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read again: unlike a checkpoint, it is computed once and read by columns."""
    path = f"{_folder(df.sparkSession.sparkContext)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: tuple[Column, ...], name: str) -> DataFrame:
    """df with its rows' places (int, from 1) in this order: within ranges of the order, after the counts of the ranges before, so
    that no task holds all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # a row for each range
    before = F.array(*[F.lit(sum(counts.get(j, 0) for j in range(i))) for i in range(max(counts, default=0) + 1)])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.get(before, F.col("_range")).cast("int")
    return placed.withColumn(name, place).drop("_range")
