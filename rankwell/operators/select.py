"""Exact selection by rank inside groups, without sorting a large group.

``pick`` finds the rows at a few 0-based ranks of every group.  A group of at most
``DIRECT_ROWS`` rows is ranked as it is.  A larger one is narrowed down first: a
sample drawn by hash gives two bounds around each wanted rank, one aggregate
counts exactly what lies below and between them, and only rows between the bounds
go on, until they are few enough.  A bound that misses its rank is drawn again
from another sample, so the result is exact whatever the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import bounded_broadcast

#: Rows of a group, or of a part of one, that are ranked by one task; rows of a sample.
DIRECT_ROWS, SAMPLE_ROWS = 1 << 17, 1 << 12
#: Parts of groups that are broadcast (one row each); more are joined by a shuffle.
MAX_BROADCAST_PARTS = 100_000


def _inside(rows: DataFrame, parts: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of every part: between its bounds, the lower one included; a null bound is open."""
    at = F.struct("key", "tie")
    return rows.join(bounded_broadcast(parts, MAX_BROADCAST_PARTS), groups).where(
        (F.col("lo").isNull() | (at >= F.col("lo"))) & (F.col("hi").isNull() | (at < F.col("hi"))))


def _narrowed(rows: DataFrame, parts: DataFrame, groups: list[str], attempt: int) -> DataFrame:
    """Every wanted rank of ``parts`` as a part of its own with closer bounds (or the old ones, if they missed)."""
    share = F.greatest(F.floor(F.col("m") / SAMPLE_ROWS), F.lit(1))
    drawn = _inside(rows, parts, groups).where(F.pmod(F.xxhash64(*groups, "key", "tie", F.lit(attempt)), share) == 0)
    sample = drawn.groupBy(*groups, "part").agg(F.sort_array(F.collect_list(F.struct("key", "tie"))).alias("sample"))
    wanted = parts.join(sample, [*groups, "part"], "left").select("*", F.explode("ranks").alias("r"))
    size = F.coalesce(F.size("sample"), F.lit(0))
    near, slack = F.col("r.at") / F.col("m") * size, 2 * F.sqrt(size) + 2  # four standard deviations

    def bound(i: Column, old: str) -> Column:
        i = i.cast("int")
        return F.when((i >= 0) & (i < size), F.get("sample", i)).otherwise(F.col(old))

    closer = wanted.select(
        *groups, "part", F.col("r.rank").alias("rank"), F.col("r.at").alias("at"), "m", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"),
        bound(F.floor(near - slack), "lo").alias("new_lo"), bound(F.ceil(near + slack), "hi").alias("new_hi"))
    closer = cut_lineage(closer.withColumn("_part", F.concat_ws(".", "part", F.col("rank").cast("string"), F.lit(str(attempt)))))
    # what lies below the new lower bound, and between the bounds, counted over all rows of the old part
    met = _inside(rows, closer.withColumnsRenamed({"old_lo": "lo", "old_hi": "hi"}), groups)
    at = F.struct("key", "tie")
    below = F.col("new_lo").isNotNull() & (at < F.col("new_lo"))
    between = ~below & (F.col("new_hi").isNull() | (at < F.col("new_hi")))
    counted = met.groupBy(*groups, "_part").agg(F.count(F.when(below, 1)).alias("below"), F.count(F.when(between, 1)).alias("between"))
    out = closer.join(counted, [*groups, "_part"])
    place = F.col("at") - F.col("below")
    hit = (place >= 0) & (place < F.col("between"))
    ranks = F.array(F.struct("rank", F.when(hit, place).otherwise(F.col("at")).alias("at")))
    return out.select(
        *groups, F.col("_part").alias("part"), F.when(hit, F.col("new_lo")).otherwise(F.col("old_lo")).alias("lo"),
        F.when(hit, F.col("new_hi")).otherwise(F.col("old_hi")).alias("hi"), F.when(hit, F.col("between")).otherwise(F.col("m")).alias("m"), ranks.alias("ranks"))


def pick(rows: DataFrame, groups: Sequence[str], ranks: int, at: Callable[[Column, Column], Column]) -> DataFrame:
    """``(groups, rank, key, tie)``: the row at 0-based place ``at(n, rank)`` of each group, rank = 0 .. ``ranks`` - 1.

    ``rows`` has ``(groups, key double, tie string)``, ordered by key, then tie; n is
    the number of rows of the group (long).  ``tie`` must tell rows of one key apart.
    """
    groups = list(groups)
    rows = rows.select(*groups, "key", "tie")
    bound = "struct<key:double,tie:string>"
    wanted = F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda i: F.struct(i.alias("rank"), at(F.col("m"), i).cast("long").alias("at")))
    parts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("m")).select(
        *groups, F.lit("").alias("part"), F.lit(None).cast(bound).alias("lo"), F.lit(None).cast(bound).alias("hi"), "m", wanted.alias("ranks"))
    parts = cut_lineage(parts)
    for attempt in range(1, 65):
        large = parts.where(F.col("m") > DIRECT_ROWS)
        if large.limit(1).count() == 0:
            break
        parts = cut_lineage(parts.where(F.col("m") <= DIRECT_ROWS).unionByName(_narrowed(rows, large, groups, attempt)))
    else:
        raise RuntimeError("rows of a group cannot be told apart by key and tie")
    inside = _inside(rows, parts, groups)
    place = F.row_number().over(Window.partitionBy(*groups, "part").orderBy("key", "tie")) - 1
    found = inside.withColumn("place", place.cast("long")).withColumn("r", F.explode(F.filter("ranks", lambda r: r["at"] == F.col("place"))))
    return found.select(*groups, F.col("r.rank").alias("rank"), "key", "tie")
