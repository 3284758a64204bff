"""Tables between the steps of a plan, written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(rows: DataFrame) -> DataFrame:
    """rows as a written table: what several later steps read is computed once, and plans stay small. The tables stay until `clear`.

    They lie below spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster, whose
    executors would not share it, that is an error.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share.")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/lectern-staged"
    path = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(rows.schema).parquet(path)


_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes all tables that `staged` has written so far, once their results are no longer needed; returns how many."""
    many = len(_WRITTEN)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return many
