"""Ranking metrics per query and their means.

Definitions (trec_eval style, linear gain):

* ``ndcg_at_k``      sum over ranks i<=k with rel>0 of rel/log2(i+1), divided
                     by the same sum over the judged grades sorted descending
* ``map_at_k``       sum over hits i<=k of precision@i, divided by R
* ``recall_at_k``    hits in the top k / R
* ``precision_at_k`` hits in the top k / k (even when fewer were returned)
* ``mrr_at_k``       1 / rank of the first hit within k, else 0
* ``cv_recall_at_k`` 1 if any hit within k, else 0

R is the number of judged documents with rel > 0.  Unjudged hits count as
rel 0.  Queries with R = 0 score 0.  Ranking inside a query is score
descending then document id descending (recomputed here, so filtered runs
are ranked by what is left).  The evaluated queries are a *spine*: the
query ids of the unfiltered run that also appear in the qrels, so a query
whose hits were all filtered away still counts with zeros.

Plan: the run is cut to ``max(k)`` hits per query first (window limits before
and after the shuffle), or a stored rank is trusted.  The judgments are read
once: they meet the hits in one full outer join on (qid, did), are counted per
(query, grade) with partial aggregation - so a query with many judged documents
is no large group - and folded into one row per query with its hit ranks and
its grade counts.  Unjudged hits have grade 0 and change no metric.

``ClassQrels`` judges by classes of queries and documents instead of pairs, for
judgments like "same label": nothing of the size queries x documents is built.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import local_rows
from .rank import rank, top_k

DEFAULT_K_VALUES = (1, 3, 5, 10, 20, 100, 1000)
METRICS = ("ndcg", "map", "recall", "precision", "mrr", "cv_recall")
DECIMALS = 9


def judged(run: DataFrame, qrels: "DataFrame | PairQrels | ClassQrels", k_max: int, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``k_max`` hits per query with their grade (0 when unjudged) and hit flag."""
    keys = list(keys)
    ranked = top_k(run.select(*keys, "qid", "did", "score"), k_max, keys=[*keys, "qid"])
    return (
        judgments(qrels).grades_of_hits(ranked, keys)
        .withColumn("rel", F.coalesce(F.col("rel"), F.lit(0)))
        .withColumn("hit", (F.col("rel") > 0).cast("int"))
    )


def spine(run_qids: DataFrame, qrels: "DataFrame | PairQrels | ClassQrels", keys: Sequence[str] = ()) -> DataFrame:
    """Evaluated queries: ids of the (unfiltered) run that have judgments."""
    keys = list(keys)
    return run_qids.select(*keys, F.col("qid").cast("string")).distinct().join(judgments(qrels).judged_queries(keys), [*keys, "qid"], "left_semi")


def judgments(qrels: "DataFrame | PairQrels | ClassQrels") -> "PairQrels | ClassQrels":
    """Either kind of judgments behind one interface: ``grades_of_hits``, ``judged_queries`` and ``folded``."""
    return PairQrels(qrels) if isinstance(qrels, DataFrame) else qrels


class PairQrels:
    """Judgments as rows ``(keys, qid, did, rel)``."""

    def __init__(self, qrels: DataFrame):
        self.qrels = qrels

    def where(self, condition) -> "PairQrels":
        """The judgments of some keys (a condition on key columns)."""
        return PairQrels(self.qrels.where(condition))

    def grades_of_hits(self, hits: DataFrame, keys: list[str]) -> DataFrame:
        """``hits`` with their grade in ``rel``, null when unjudged."""
        on = [*keys, "qid", "did"]
        return hits.join(self.qrels.select(*on, F.col("rel").cast("int").alias("rel")), on, "left")

    def judged_queries(self, keys: list[str]) -> DataFrame:
        """``(keys, qid)`` of queries with a judgment."""
        return self.qrels.select(*keys, "qid").distinct()

    def folded(self, hits: DataFrame, keys: list[str]) -> DataFrame:
        """``(keys, qid, judged, found, grades array<(rel, n)>, hits array<(rk, rel)>)`` of every query of
        either side; ``hits`` has ``(keys, qid, did, rk)``."""
        on = [*keys, "qid", "did"]
        rel = self.qrels.select(*on, F.col("rel").cast("int").alias("rel"))
        j = rel.join(hits.select(*on, "rk"), on, "full_outer")
        per = j.groupBy(*keys, "qid", "rel").agg(
            F.count(F.lit(1)).alias("n"), F.count("rk").alias("nf"), F.collect_list(F.when(F.col("rel") > 0, F.col("rk"))).alias("rks"))
        graded = F.when(F.col("rel") > 0, F.struct("rel", "n"))
        ranks = F.collect_list(F.when(F.size("rks") > 0, F.transform("rks", lambda r: F.struct(r.alias("rk"), F.col("rel").alias("rel")))))
        return per.groupBy(*keys, "qid").agg(
            F.max(F.col("rel").isNotNull()).alias("judged"), (F.sum("nf") > 0).alias("found"),
            F.collect_list(graded).alias("grades"), F.flatten(ranks).alias("hits"))


#: Rules and class sizes of at most so many rows become part of the plan; more are joined as tables.
MAX_CLASS_ROWS = 10_000


class ClassQrels:
    """Judgments by class: ``rules`` gives the grade of (query class, document class).

    ``queries`` (keys, qid, qclass), ``docs`` (keys, did, dclass) and ``rules``
    (qclass, dclass, rel) have one row each per query, document and judged pair of
    classes.  With ``skip_identical`` the document whose id is the query's is not
    judged.  The hits of a query and its own document meet the classes of documents
    in one join; how many documents have which grade comes from one aggregate over
    the classes.  Tables of classes are read once and kept in the plan while small.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, rules: DataFrame, skip_identical: bool = True):
        self.queries, self.docs, self.rules, self.skip_identical = queries, docs, rules, skip_identical
        self._kept: dict = {}

    def where(self, condition) -> "ClassQrels":
        """The judgments of some keys (a condition on key columns)."""
        return ClassQrels(self.queries.where(condition), self.docs.where(condition), self.rules, self.skip_identical)

    def _rules(self) -> DataFrame:
        if "rules" not in self._kept:
            self._kept["rules"] = local_rows(self.rules.select("qclass", "dclass", F.col("rel").cast("int").alias("rel")), MAX_CLASS_ROWS)
        return self._kept["rules"]

    def _grades(self, keys: list[str]) -> DataFrame:
        """``(keys, qclass, all_grades array<(rel, n)>)``: documents per grade, for queries of a class."""
        if ("grades", *keys) not in self._kept:
            sizes = local_rows(self.docs.groupBy(*keys, "dclass").agg(F.count(F.lit(1)).alias("n")), MAX_CLASS_ROWS)
            per = sizes.join(self._rules(), "dclass").groupBy(*keys, "qclass", "rel").agg(F.sum("n").alias("n"))
            self._kept["grades", *keys] = per.groupBy(*keys, "qclass").agg(F.collect_list(F.struct("rel", "n")).alias("all_grades"))
        return self._kept["grades", *keys]

    def _counted(self, base: DataFrame, keys: list[str]) -> DataFrame:
        """Adds ``counted``, the judged documents per grade of (keys, qid, qclass, own) rows; ``own`` is the grade of
        the query's own document, which does not count."""
        zero = F.lit(0).cast("long")
        less = F.transform("all_grades", lambda g: F.struct(g["rel"].alias("rel"), (g["n"] - F.coalesce((g["rel"] == F.col("own")).cast("long"), zero)).alias("n")))
        return base.join(self._grades(keys), [*keys, "qclass"], "left").withColumn("counted", F.filter(less, lambda g: g["n"] > 0))

    def _graded(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows (keys, qclass, did, ...) with the grade of the document's class in ``rel``."""
        return rows.join(self.docs.select(*keys, "did", "dclass"), [*keys, "did"], "left").join(self._rules(), ["qclass", "dclass"], "left").drop("dclass")

    def grades_of_hits(self, hits: DataFrame, keys: list[str]) -> DataFrame:
        """``hits`` with their grade in ``rel``, null when unjudged."""
        out = self._graded(hits.join(self.queries.select(*keys, "qid", "qclass"), [*keys, "qid"], "left"), keys).drop("qclass")
        return out.withColumn("rel", F.when(F.col("qid") != F.col("did"), F.col("rel"))) if self.skip_identical else out

    def judged_queries(self, keys: list[str]) -> DataFrame:
        """``(keys, qid)`` of queries with a judged document."""
        q = self.queries.select(*keys, "qid", "qclass")
        if self.skip_identical:
            base = self._graded(q.withColumn("did", F.col("qid")), keys).withColumnRenamed("rel", "own")
        else:
            base = q.withColumn("own", F.lit(None).cast("int"))
        return self._counted(base, keys).where(F.size("counted") > 0).select(*keys, "qid").distinct()

    def folded(self, hits: DataFrame, keys: list[str]) -> DataFrame:
        """As ``PairQrels.folded``, for the queries of ``queries``."""
        hit = "array<struct<did:string,rk:int>>"
        mine = hits.groupBy(*keys, "qid").agg(F.collect_list(F.struct("did", "rk")).alias("listed"))  # cut to the depth before
        own = F.array(F.struct(F.col("qid").alias("did"), F.lit(None).cast("int").alias("rk"))) if self.skip_identical else F.array().cast(hit)
        rows = self.queries.select(*keys, "qid", "qclass").join(mine, [*keys, "qid"], "left")
        rows = rows.select(*keys, "qid", "qclass", F.inline_outer(F.concat(own.cast(hit), F.coalesce("listed", F.array().cast(hit)))))
        graded = self._graded(rows, keys)
        is_hit = F.col("rk").isNotNull()
        counts = is_hit & (F.col("rel") > 0)
        if self.skip_identical:
            counts = counts & (F.col("qid") != F.col("did"))
        per_q = graded.groupBy(*keys, "qid", "qclass").agg(
            F.max(is_hit).alias("found"), F.max(F.when(~is_hit, F.col("rel"))).alias("own"), F.collect_list(F.when(counts, F.struct("rk", "rel"))).alias("hits"))
        return self._counted(per_q, keys).select(
            *keys, "qid", (F.coalesce(F.size("counted"), F.lit(0)) > 0).alias("judged"), "found",
            F.filter("counted", lambda g: g["rel"] > 0).alias("grades"), "hits")


def _gain_sums(k_max: int):
    """Array literal: sum of 1 / log2(i + 1) over i = 1..m, at index m + 1."""
    total, out = 0.0, [0.0]
    for i in range(1, k_max + 1):
        total += 1.0 / math.log2(i + 1)
        out.append(total)
    # one constant that the optimiser folds, not an expression per entry; JSON keeps every digit
    return F.from_json(F.lit(json.dumps(out)), "array<double>")


def _ideal(k: int) -> str:
    """SQL of the ideal DCG at k from ``grades``, (grade, number) sorted by grade descending, and ``gain``."""
    end = f"least(acc.at + g.n, {k}L)"
    gained = f"element_at(gain, CAST({end} + 1 AS INT)) - element_at(gain, CAST(acc.at + 1 AS INT))"
    step = f"named_struct('at', {end}, 'dcg', acc.dcg + g.rel * ({gained}))"
    return f"aggregate(grades, named_struct('at', 0L, 'dcg', 0D), (acc, g) -> {step}, acc -> acc.dcg)"


def per_query(
    run: DataFrame,
    qrels: "DataFrame | PairQrels | ClassQrels",
    k_values: Sequence[int] = DEFAULT_K_VALUES,
    keys: Sequence[str] = (),
    run_qids: DataFrame | None = None,
    ranked: bool = False,
) -> DataFrame:
    """``(keys, qid, k, ndcg, map, recall, precision, mrr, cv_recall)``.

    ``run_qids`` are the queries the run was made for (before any candidate
    filter); by default the query ids present in ``run``.  ``ranked``: trust the
    run's own ``rk`` instead of ranking it by score.
    """
    keys = list(keys)
    ks = sorted(set(int(k) for k in k_values))
    if ranked:
        hits = run.where(F.col("rk") <= F.lit(max(ks))).select(*keys, "qid", "did", F.col("rk").cast("int").alias("rk"))
    else:
        hits = top_k(run.select(*keys, "qid", "did", "score"), max(ks), keys=[*keys, "qid"]).select(*keys, "qid", "did", "rk")
    base = judgments(qrels).folded(hits, keys).where("judged")
    if run_qids is None:
        base = base.where("found")
    else:
        base = base.join(run_qids.select(*keys, F.col("qid").cast("string").alias("qid")).distinct(), [*keys, "qid"], "left_semi")
    desc = F.reverse(F.array_sort("grades"))
    rows = base.select(*keys, "qid", desc.alias("grades"), F.posexplode_outer(F.array_sort("hits")).alias("i", "h"))
    # as SQL text: one call per expression, where the cut-offs would make thousands of Column objects
    aggs = [F.first("grades").alias("grades")]
    for k in ks:
        inside = f"CASE WHEN h.rk <= {k} THEN"
        aggs += [
            F.expr(f"sum({inside} h.rel / log2(CAST(h.rk + 1 AS DOUBLE)) ELSE 0D END) AS dcg_{k}"),
            F.expr(f"sum({inside} (i + 1) / h.rk ELSE 0D END) AS ap_{k}"),
            F.expr(f"CAST(sum({inside} 1 ELSE 0 END) AS DOUBLE) AS nhit_{k}"),
            F.expr(f"max({inside} 1D / h.rk ELSE 0D END) AS rr_{k}"),
        ]
    wide = rows.groupBy(*keys, "qid").agg(*aggs)
    relevant = F.expr("CAST(nullif(aggregate(grades, 0L, (acc, g) -> acc + g.n), 0L) AS DOUBLE)")
    wide = wide.withColumns({"R": relevant, "gain": _gain_sums(max(ks))})
    out = [
        F.expr(
            f"named_struct('k', {k}, 'ndcg', coalesce(dcg_{k} / nullif({_ideal(k)}, 0D), 0D), 'map', coalesce(ap_{k} / R, 0D), "
            f"'recall', coalesce(nhit_{k} / R, 0D), 'precision', nhit_{k} / {k}D, 'mrr', coalesce(rr_{k}, 0D), 'cv_recall', CAST(nhit_{k} > 0 AS DOUBLE))")
        for k in ks
    ]
    return wide.select(*keys, "qid", F.inline(F.array(*out)))


def to_long(pq: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide per-query rows -> ``(keys, qid, metric, k, value)`` (values rounded to 9 decimals)."""
    keys = list(keys)
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), DECIMALS).alias("value")) for m in metrics]
    )
    return pq.select(*keys, "qid", "k", F.inline(pairs))


def mean(
    pq: DataFrame,
    keys: Sequence[str] = (),
    denominator: str = "evaluated",
    qrels: "DataFrame | PairQrels | ClassQrels | None" = None,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """M9: macro mean per ``(keys, k)`` -> ``(keys, metric, k, value)``.

    ``denominator="evaluated"`` averages over the evaluated queries;
    ``"qrels"`` divides the sum by the number of distinct query ids in the
    qrels (queries missing from the run count as 0).
    """
    keys = list(keys)
    long = to_long(pq, keys, metrics)
    summed = long.groupBy(*keys, "metric", "k").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    if denominator == "evaluated":
        out = summed.withColumn("value", F.col("s") / F.col("n"))
    elif denominator == "qrels":
        if qrels is None:
            raise ValueError("denominator='qrels' needs the qrels table")
        judged_q = judgments(qrels).judged_queries(keys)
        if keys:
            nq = judged_q.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq"))
            out = summed.join(nq, keys).withColumn("value", F.col("s") / F.col("nq"))
        else:  # one scalar: the number of query ids in the qrels
            nq = judged_q.count()
            out = summed.withColumn("value", F.col("s") / F.lit(float(nq)))
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    return out.select(*keys, "metric", "k", F.round("value", DECIMALS).alias("value"))


def metric_name(metric: str | F.Column, k) -> F.Column:
    """``ndcg`` + 10 -> ``ndcg_at_10``; ``nauc_ndcg:max`` + 10 -> ``nauc_ndcg_at_10_max``
    (the reference's result keys)."""
    m = F.lit(metric) if isinstance(metric, str) else metric
    kk = (F.lit(k) if isinstance(k, int) else k).cast("string")
    base = F.split(m, ":")
    plain = F.concat(F.get(base, 0), F.lit("_at_"), kk)
    return F.when(F.size(base) > 1, F.concat(plain, F.lit("_"), F.get(base, 1))).otherwise(plain)


def evaluate(
    run: DataFrame,
    qrels: DataFrame,
    k_values: Sequence[int] = DEFAULT_K_VALUES,
    keys: Sequence[str] = (),
    run_qids: DataFrame | None = None,
    denominator: str = "evaluated",
    ranked: bool = False,
) -> DataFrame:
    """Run + qrels -> mean metrics ``(keys, metric, k, value)``."""
    pq = per_query(run, qrels, k_values, keys, run_qids, ranked)
    return mean(pq, keys, denominator, qrels)


def with_rank(run: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rank(run, [*keys, "qid"])
