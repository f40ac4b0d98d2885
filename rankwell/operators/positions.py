"""Exact 0-based positions inside groups, without sorting a group in one task.

A window ``row_number() over (partition by g order by o)`` sorts each group
inside a single task.  Here the rows are range-partitioned and sorted over
all tasks (``orderBy``), every task numbers its own rows (``mapInArrow``),
and per-partition counts - one row per partition - give the offsets.  The
numbered rows are checkpointed into the shared checkpoint folder first.  A
group's first global position is its minimum, found by a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    seen = 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([pid] * n, pa.int32()), pa.array(range(seen, seen + n), pa.int64())],
            names=[*b.schema.names, "_pid", "_lidx"],
        )
        seen += n


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence) -> DataFrame:
    """Add ``pos`` (0-based, within the group, in ``order_cols`` order) and ``n`` (group size).

    ``order_cols`` must make the order total (append a unique id).
    """
    groups = list(group_cols)
    ordered = df.orderBy(*[F.col(g) for g in groups], *order_cols)
    schema = StructType(ordered.schema.fields + [StructField("_pid", IntegerType()), StructField("_lidx", LongType())])
    # materialised once: both consumers below must see the same partition ids
    numbered = cut_lineage(ordered.mapInArrow(_number, schema))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    glob = numbered.join(F.broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + F.col("_lidx"))
    starts = glob.groupBy(*groups).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("n"))
    return (
        glob.join(starts, groups)
        .withColumn("pos", F.col("_g") - F.col("_start"))
        .drop("_pid", "_lidx", "_off", "_g", "_start")
    )
