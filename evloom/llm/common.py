"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the query contracts define it: a run of anything but space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch. A batch is held in memory whole; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder under /tmp; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/evloom-shared"
    return found.rstrip("/")


#: Paths of tables that this process has stored for the time being.
_STORED: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored() -> set[str]:
    return set(_STORED)


def discard(spark: SparkSession, paths: set[str], names: tuple[str, ...] = ()) -> None:
    """Removes those stored tables, or of them the ones with such names, and lets Spark remove shuffle files that nothing refers to.

    Only for callers who know that no result that still has to be computed reads them.
    """
    for path in [p for p in _STORED if p in paths and (not names or p.rpartition("/")[2].rpartition("-")[0] in names)]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STORED.remove(path)
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of operators that take whole texts to Python, for the whole session and only ever downwards."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def raw_text(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes (null stays null), for Arrow functions."""
    small_batches(df.sparkSession)
    return df.select(*keep, F.col("text").cast("binary").alias("text"))


def crc_mod(col: str, n: int):
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n
