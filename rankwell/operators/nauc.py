"""Abstention AUC of per-query metrics (M7, M8).

For every (keys, metric, k) and confidence signal: sort queries by confidence
ascending (ties by query id), for each abstention rate r in 0, 0.1 .. 0.9 drop
``min(round_half_even(r * n), n - 1)`` lowest queries and average the metric
over the rest -> curve; AUC by the trapezoid rule.  The oracle curve sorts by
the metric itself; flat AUC = oracle curve at 0 x 0.9.
``nauc = (auc - flat) / (auc_oracle - flat)``, null when the denominator is 0
(below 1e-12, so a flat oracle curve does not divide by rounding noise).

Confidence signals per query from its scored hits: ``max`` (top score),
``std`` (population standard deviation), ``diff1`` (top minus second, 0 for a
single hit); a query without hits has confidence 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import bounded_broadcast
from .rank import top_k
from .score import MAX_BROADCAST_GROUPS
from .select import pick

RATES = 10  # 0, 0.1, ..., 0.9
SIGNALS = ("max", "std", "diff1")
NAUC_METRICS = ("ndcg", "map", "recall", "precision", "mrr")
DECIMALS = 9


def confidence(run: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, qid, max, std, diff1)`` from each query's scores.

    The two best scores come from a top-2 cut (window limits), the deviation
    from a plain aggregate: no query's run is sorted as a whole.
    """
    keys = list(keys)
    run = run.select(*keys, "qid", "did", "score")
    spread = run.groupBy(*keys, "qid").agg(F.stddev_pop("score").alias("std"))
    s1, s2 = (F.max(F.when(F.col("rk") == i, F.col("score"))) for i in (1, 2))
    best = top_k(run, 2, [*keys, "qid"]).groupBy(*keys, "qid").agg(s1.alias("s1"), s2.alias("s2"))
    return best.join(spread, [*keys, "qid"]).select(
        *keys, "qid", F.round("s1", DECIMALS).alias("max"), F.round("std", DECIMALS).alias("std"),
        F.round(F.coalesce(F.col("s1") - F.col("s2"), F.lit(0.0)), DECIMALS).alias("diff1"))


def _drops(n, rate):
    """Queries that abstain at a rate (number 0 .. RATES - 1): half-even rounding, one query stays."""
    return F.least(F.bround(rate * F.lit(0.1) * n, 0).cast("long"), n - 1)


def nauc(per_query_long: DataFrame, conf: DataFrame, keys: Sequence[str] = (),
         metrics: Sequence[str] = NAUC_METRICS) -> DataFrame:
    """``(keys, metric, k, signal, value)`` from long per-query metrics and confidences.

    A query has one row with its signals and all its metric values, kept in the
    shared folder.  Only the first query that stays at each rate is looked up, per
    signal and per metric and cut-off for the oracle (``operators.select``).  Every
    query then falls between two of these ten cuts, and values are added per
    interval with partial aggregation: no order of all queries is built.
    """
    keys = list(keys)
    vals = F.collect_list(F.struct("metric", "k", "value")).alias("vals")  # as many as metrics and cut-offs
    wide = per_query_long.where(F.col("metric").isin(list(metrics))).groupBy(*keys, "qid").agg(vals)
    wide = cut_lineage(wide.join(conf.select(*keys, "qid", *SIGNALS), [*keys, "qid"], "left"))
    by_signal = [F.struct(F.lit(s).alias("name"), F.coalesce(F.col(s), F.lit(0.0)).alias("key")) for s in SIGNALS]
    by_value = F.transform("vals", lambda v: F.struct(F.concat_ws("@", v["metric"], v["k"].cast("string")).alias("name"), v["value"].alias("key")))
    items = wide.select(*keys, "qid", "vals", F.inline(F.concat(F.array(*by_signal), by_value)))
    cuts = pick(items.select(*keys, "name", "key", F.col("qid").alias("tie")), [*keys, "name"], RATES, _drops)
    first = cut_lineage(cuts.groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "tie"))).alias("cuts")))  # ten each
    placed = items.join(bounded_broadcast(first, MAX_BROADCAST_GROUPS), [*keys, "name"])
    stays = F.filter("cuts", lambda c: (F.col("key") > c["key"]) | ((F.col("key") == c["key"]) & (F.col("qid") >= c["tie"])))
    own = F.filter("vals", lambda v: F.concat_ws("@", v["metric"], v["k"].cast("string")) == F.col("name"))
    is_signal = F.col("name").isin(list(SIGNALS))
    placed = placed.select(*keys, "name", F.size(stays).alias("last"), F.inline(F.when(is_signal, F.col("vals")).otherwise(own)))
    g = [*keys, "metric", "k"]
    sums = placed.groupBy(*g, "name", "last").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    curve = [(F.sum(F.when(F.col("last") > i, F.col("s")).otherwise(0.0)) / F.sum(F.when(F.col("last") > i, F.col("n")).otherwise(0))).alias(f"c{i}") for i in range(RATES)]
    areas = sums.groupBy(*g, "name").agg(*curve).select(*g, "name", _area().alias("auc"), (F.col("c0") * F.lit((RATES - 1) * 0.1)).alias("flat"))
    oracle = areas.where(~is_signal).select(*g, F.col("auc").alias("or_auc"), "flat")
    den = F.col("or_auc") - F.col("flat")
    value = F.when(F.abs(den) < F.lit(1e-12), F.lit(None).cast("double")).otherwise((F.col("auc") - F.col("flat")) / den)
    sig = areas.where(is_signal).select(*g, F.col("name").alias("signal"), "auc")
    return sig.join(oracle, g).select(*g, "signal", F.round(value, DECIMALS).alias("value"))


def _area():
    """Trapezoid rule over the curve."""
    out = F.lit(0.0)
    for i in range(RATES - 1):
        out = out + F.lit((i + 1) * 0.1 - i * 0.1) * (F.col(f"c{i}") + F.col(f"c{i + 1}")) / F.lit(2.0)
    return out


def nauc_name(metric, k, signal) -> F.Column:
    """``nauc_ndcg_at_10_max`` (the reference's result key)."""
    return F.concat(F.lit("nauc_"), F.col(metric), F.lit("_at_"), F.col(k).cast("string"), F.lit("_"), F.col(signal))
