"""What the operators of this subpackage share: words, scratch tables in the cluster's shared folder, sums of hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: what separates words, as a character class of Java's and Python's patterns.
SPACE = r"\x20\x09-\x0D"
#: Rows of a batch of texts that goes to Python.
BATCH = 512
BATCH_BYTES = 8 << 20


#: The temporary folders of applications with a local master.
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on Python workers get BATCH rows or about BATCH_BYTES bytes at a time: with whole texts in a row, Spark's 10,000 are too many.

    Spark reads these settings when a plan runs, so they stay lowered for the session; they change no result."""
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where lambdas inside body refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
