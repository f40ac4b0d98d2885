"""Shared helpers of the training-data operators: tables in the shared folder, label and text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.session import ensure_checkpoint_dir, read_table, ship_package
from rankwell.session import scratch_path as registered_path

#: Words in the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; ships the package to the Python workers."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (each run has its own); ``session.drop_scratch`` removes it."""
    prepare(spark)
    return registered_path(spark, f"llm-{tag}")


def staged(df: DataFrame, tag: str, compression: str = "zstd", rows_at_once: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, large rows ``rows_at_once``.

    Cuts lineage in a way that survives lost executors; column pruning and
    filters still reach the scan of the table.
    """
    path = scratch_path(df.sparkSession, tag)
    out = df.write.option("compression", compression)
    (out.option("parquet.block.row.count.limit", rows_at_once) if rows_at_once else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other characters take the fast built-in ``lower``."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


#: Keys of a lookup table that are broadcast at most because they have many rows, and the rows that make a key so.
HEAVY_KEYS, HEAVY_ROWS = 20_000, 1_000


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Inner join with a table that has one row per key and in ``weight`` about how many ``rows`` the key has.

    Keys of more than ``HEAVY_ROWS`` rows and more than 1 / ``HEAVY_KEYS`` of all
    rows, so fewer than ``HEAVY_KEYS``, are broadcast: their rows stay where they
    are.  All others meet by a shuffle, in which no key is large.
    """
    on = list(on)
    total = int(table.agg(F.sum(weight)).first()[0] or 0)
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy, light = table.where(F.col(weight) > limit), table.where(F.col(weight) <= limit)
    if total <= limit or heavy.limit(1).count() == 0:
        return rows.join(table, on)
    inside = rows.join(F.broadcast(heavy), on)
    outside = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return inside.unionByName(outside.select(*inside.columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")
