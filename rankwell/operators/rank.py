"""Per-query ranking: exact top-k, merge of partial top-k, skip-first, cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sort_key


def rank_order(score: str = "score", did: str = "did"):
    """Score descending (by its scale-relative key), then document id descending."""
    return [sort_key(score).desc(), F.col(did).desc()]


def rank(run: DataFrame, keys: Sequence[str] = ("qid",), score: str = "score", did: str = "did") -> DataFrame:
    """Add ``rk`` (1-based) per query without a cut (full-depth ranking, T3)."""
    w = Window.partitionBy(*keys).orderBy(*rank_order(score, did))
    return run.withColumn("rk", F.row_number().over(w))


def top_k(
    run: DataFrame, k: int, keys: Sequence[str] = ("qid",), score: str = "score", did: str = "did"
) -> DataFrame:
    """Exact top-k per query.

    Top-k is associative, so this also merges partial top-k lists of corpus
    chunks (T2): Spark plans it as a partial window limit before the shuffle
    by query and a final one after it, as long as k is at most
    ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond it, all partial
    lists are shuffled, which the search has already cut to k per task.
    """
    return rank(run, keys, score, did).where(F.col("rk") <= F.lit(k))


def skip_first(run: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """T4: drop the first hit of every query and re-rank the rest."""
    if "rk" not in run.columns:
        run = rank(run, keys)
    return run.where(F.col("rk") > 1).withColumn("rk", F.col("rk") - 1)


def cut(run: DataFrame, k: int) -> DataFrame:
    """The first k hits in rank order (needs ``rk``)."""
    return run.where(F.col("rk") <= F.lit(k))
