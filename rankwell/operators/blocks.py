"""Block pairing: bring a size-checked small side to every chunk of a big side.

The small side (queries, passages) is packed into ``n`` blocks of bounded
bytes; the big side (corpus, documents) is packed into chunk rows per input
partition with ``mapInArrow`` (no shuffle).  Chunks meet blocks through an
equi-join on the block id:

* whole small side within the broadcast budget -> broadcast hash join, the
  big side is not shuffled for the join;
* otherwise -> every block is replicated over ``S`` salts and the chunks are
  hashed over (block, salt), a 2-D partitioned block product that spreads
  the work over ``blocks x salts`` shuffle keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONF_BROADCAST_BYTES = "rankwell.blocks.broadcastBytes"
CONF_TARGET_TASKS = "rankwell.blocks.targetTasks"
DEFAULT_BROADCAST_BYTES = 64 << 20
# Inputs below this many estimated bytes per core are dealt evenly over the cores.
SPREAD_BYTES = 16 << 20
# Bytes of a chunk row: a task holds some of them, whatever the size of an Arrow batch.
CHUNK_BYTES = 8 << 20


def conf_int(spark, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except Exception:  # noqa: BLE001 - unset or unreadable setting
        return default


def plan_bytes(df: DataFrame) -> int:
    """Size of a DataFrame as its optimised plan estimates it (metadata only, nothing runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input evenly over the cores.

    An input whose estimated size is below ``SPREAD_BYTES`` per core may sit in
    one or two files; larger inputs already have many partitions and are left
    as they are (no shuffle).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < SPREAD_BYTES * cores else df


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows (counted), as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local_rows(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, read once and kept in the plan itself; larger ones as they are."""
    got = df.limit(rows + 1).toArrow()
    return df.sparkSession.createDataFrame(got, df.schema) if got.num_rows <= rows else df


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``CHUNK_BYTES``."""
    for whole in batches:
        step = max(1, int(whole.num_rows * CHUNK_BYTES // max(1, whole.nbytes)))
        for lo in range(0, whole.num_rows, step):
            yield whole.slice(lo, step)


def pack_partitions(df: DataFrame, fields: Sequence[str], out: str = "items", id_out: str = "cb") -> DataFrame:
    """One row per Arrow batch of each partition, or per ``CHUNK_BYTES`` of it: ``(cb, items array<struct<fields>>)``."""
    fields = list(fields)
    item_type = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.select(*fields).schema.fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        n = 0
        for batch in _slices(batches):
            items = pa.StructArray.from_arrays([batch.column(f) for f in fields], names=fields)
            packed = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), items)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | n], pa.int64()), packed], names=[id_out, out])
            n += 1

    return df.select(*fields).mapInArrow(pack, f"{id_out} bigint, {out} array<struct<{item_type}>>")


def pack_groups(df: DataFrame, groups: Sequence[str], fields: Sequence[str], out: str = "items") -> DataFrame:
    """One row per group and Arrow batch of each partition, or ``CHUNK_BYTES`` of it: ``(groups, items array<struct<fields>>)``, without a shuffle."""
    groups, fields = list(groups), list(fields)
    src = df.select(*groups, *fields)
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            code = np.zeros(batch.num_rows, np.int64)
            for g in groups:
                values = batch.column(g).dictionary_encode()
                own = values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False)
                code = code * (len(values.dictionary) + 1) + own
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            rows = batch.take(pa.array(order))
            items = pa.StructArray.from_arrays([rows.column(f) for f in fields], names=fields)
            packed = pa.ListArray.from_arrays(pa.array([*starts, batch.num_rows], pa.int32()), items)
            first = rows.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(first.column(g) for g in groups), packed], names=[*groups, out])

    schema = ", ".join([f"`{g}` {types[g]}" for g in groups] + [f"{out} array<struct<{', '.join(f'`{f}`: {types[f]}' for f in fields)}>>"])
    return src.mapInArrow(pack, schema)


def pack_blocks(df: DataFrame, key: str, fields: Sequence[str], n_blocks: int, out: str = "items") -> DataFrame:
    """Small side -> ``n_blocks`` rows ``(blk, items)`` hashed on ``key``."""
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("blk")).agg(
        F.collect_list(F.struct(*[F.col(f) for f in fields])).alias(out)
    )


def n_blocks_for(total_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / max(1, block_bytes)))


def pair_blocks(chunks: DataFrame, blocks: DataFrame, n_blocks: int, total_bytes: int,
                broadcast_bytes: int | None = None) -> DataFrame:
    """Every chunk row joined with every block row, as an equi-join on ``blk``.

    ``broadcast_bytes`` overrides the session's budget (``CONF_BROADCAST_BYTES``).
    """
    spark = chunks.sparkSession
    ids = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))
    fanned = chunks.withColumn("blk", ids)
    budget = conf_int(spark, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES) if broadcast_bytes is None else broadcast_bytes
    if total_bytes <= budget:
        return fanned.join(F.broadcast(blocks), "blk")
    target = conf_int(spark, CONF_TARGET_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    salts = max(1, math.ceil(target / n_blocks))
    rep = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    keyed = fanned.withColumn("salt", F.pmod(F.xxhash64(F.col(chunks.columns[0])), F.lit(salts)))
    # the size check said "too big to broadcast": keep Spark's estimate from overruling it
    return keyed.join(rep.hint("shuffle_hash"), ["blk", "salt"]).drop("salt")
