"""Weighted rendezvous hashing of stable record keys, and gapless positions within a shard.

A record's shard is the one whose score ``-weight / ln(u)`` is largest, ``u`` in (0, 1) being a hash
of key and shard number.  Key and shards alone decide, so one more shard takes records only into
itself, as many as its share of the weights.

Positions: each task counts its rows by shard while it writes them, and a table of these counts, one
row a task and shard, tells where each task begins.  No row is moved for it and no order is needed,
so any number of equal rows, null keys or null texts makes no hot task.

Null keys hash like any other value; null and empty texts have size 1; texts are never cut.  Repeated
rows each get a position.  An empty table gives no rows.  Further columns stay as they are, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import column, fresh, stored

SHARDS = 8
#: Most rows of the table of starts that are broadcast (24 bytes each); larger ones are joined by shuffle.
STARTS = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) of ``key`` among ``len(weights)`` shards; equal scores go to the smaller number."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.lit(shard), key), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("ahead"))

    best = F.greatest(*[score(s, w) for s, w in enumerate(weights)]) if len(weights) > 1 else score(0, weights[0])
    return (-best["ahead"]).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """``df`` with its rows' shard in column ``name`` (replacing one of that name)."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def with_slots(df: DataFrame, shard_col: str, name: str = "slot") -> DataFrame:
    """``df`` with each row's position in its shard, gapless from 0, in column ``name`` (replacing one of that name).

    The rows are written once, numbered within task and shard; the order of positions means nothing.
    """
    df = df.drop(name)
    task, place = fresh(df, "__task"), fresh(df, "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            shards, at = np.asarray(column(b, shard_col)), np.zeros(b.num_rows, np.int64)
            for s in np.unique(shards).tolist():
                mine = shards == s
                n = int(mine.sum())
                at[mine] = seen.get(s, 0) + np.arange(n)
                seen[s] = seen.get(s, 0) + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, number, np.int32)), pa.array(at)], [*b.schema.names, task, place])

    rows = stored(df.mapInArrow(run, StructType([*df.schema.fields, StructField(task, IntegerType()), StructField(place, LongType())])))
    count, start = fresh(df, "__count"), fresh(df, "__start")
    before = Window.partitionBy(shard_col).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard_col, task).agg(F.count(F.lit(1)).alias(count)).select(shard_col, task, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    if starts.count() <= STARTS:
        starts = F.broadcast(starts)
    return rows.join(starts, [shard_col, task]).select(*df.columns, (F.col(start) + F.col(place)).alias(name))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal weight by their id, and their shard were there one more."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = shard(shard(rows, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return with_slots(rows, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
