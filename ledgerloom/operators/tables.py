"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has it, else (a local session, as in tests) a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a part of ``parts_of``
PART_ROWS = 250_000


def parts_of(table: DataFrame) -> int:
    """Into how many parts to deal out what comes of a table, so that a task holds no more of a larger one. The rows of a
    table in files are counted from their footers."""
    return table.count() // PART_ROWS + 1
