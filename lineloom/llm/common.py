"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice of an Arrow batch may bring into Python objects at a time.
SLICE_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only a local master may fall back to its own disk."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lineloom-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared checkpoint folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> str:
    """Where in the shared checkpoint folder ``df`` was written, as Parquet."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/lineloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back with its schema."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`store` wrote, when nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the text of one slice stays near ``limit`` bytes; a longer single row stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, min(batch.num_rows, batch.num_rows * limit // size))
        for at in range(0, batch.num_rows, step):
            # A copy: Spark's reader does not take a text column that starts within another's buffer.
            yield batch if step == batch.num_rows else batch.take(pa.array(np.arange(at, min(at + step, batch.num_rows))))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column called exactly ``name``."""
    return batch.column(batch.schema.get_field_index(name))


def hash_sample(df: DataFrame, key: str, bound: int, salt: str, rows: int | None = None) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, chosen by a hash of ``key``: the same rows whatever the partitioning."""
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    cut = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(cut)) < F.lit(int(cut * bound / rows)))


def labelled(labels: DataFrame, label: str, keep, bound: int | None = None) -> DataFrame:
    """``(doc_id, label)`` of the labelled rows for which ``keep`` holds: one row an id; with ``bound`` about so many rows at most.

    Contradictory labels of one id become the larger one; null ids and null labels take no part.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows if bound is None else hash_sample(rows, "doc_id", bound, f"fit-{label}")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))
