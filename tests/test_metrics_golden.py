"""Hand-computed golden run (ties, missing queries, zero hits) and the flagship numbers."""

import math

import pytest
from pyspark.sql import functions as F

from rankwell.operators import metrics as M
from rankwell.operators.candidates import filter_lenient
from rankwell.operators.nauc import confidence, nauc
from rankwell.operators.score import search

RUN = [("q1", "d1", 0.9), ("q1", "d2", 0.8), ("q1", "d3", 0.8), ("q1", "d4", 0.5)]
QRELS = [("q1", "d2", 2), ("q1", "d4", 1), ("q1", "d9", 1)]
GOLD = {  # k: ndcg, map, recall, precision, mrr, cv_recall
    1: (0, 0, 0, 0, 0, 0),
    3: (0.319393943, 0.111111111, 0.333333333, 0.333333333, 0.333333333, 1),
    10: (0.456949427, 0.277777778, 0.666666667, 0.2, 0.333333333, 1),
}


def _df(spark, data, schema):
    return spark.createDataFrame(data, schema)


def _means(df):
    return {(r["metric"], r["k"]): r["value"] for r in df.collect()}


def test_golden_per_query(spark):
    run = _df(spark, RUN, "qid string, did string, score double")
    qrels = _df(spark, QRELS, "qid string, did string, rel int")
    pq = {r["k"]: r for r in M.per_query(run, qrels, (1, 3, 10)).collect()}
    for k, want in GOLD.items():
        got = [pq[k][m] for m in M.METRICS]
        assert got == pytest.approx(want, abs=1e-9), k


def test_tie_order_is_larger_id_first(spark):
    run = _df(spark, RUN, "qid string, did string, score double")
    ranked = {r["did"]: r["rk"] for r in M.with_rank(run).collect()}
    assert ranked == {"d1": 1, "d3": 2, "d2": 3, "d4": 4}


def test_denominators_and_missing_queries(spark):
    run = _df(spark, RUN + [("q3", "d1", 0.7)], "qid string, did string, score double")
    qrels = _df(spark, QRELS + [("q2", "d5", 1)], "qid string, did string, rel int")
    pq = M.per_query(run, qrels, (1, 3, 10))
    ev, qr = _means(M.mean(pq)), _means(M.mean(pq, denominator="qrels", qrels=qrels))
    for k, want in GOLD.items():
        for m, w in zip(M.METRICS, want):
            assert ev[(m, k)] == pytest.approx(w, abs=1e-9)
            assert qr[(m, k)] == pytest.approx(w / 2, abs=1e-9)


def test_query_emptied_by_filter_counts_as_zero(spark):
    run = _df(spark, RUN + [("q4", "d1", 0.9), ("q4", "d7", 0.4)], "qid string, did string, score double")
    qrels = _df(spark, QRELS + [("q4", "d7", 1)], "qid string, did string, rel int")
    cand = _df(spark, [("q4", None)], "qid string, did string")  # empty list: no hits survive
    kept = filter_lenient(run, cand)
    assert kept.where("qid = 'q4'").count() == 0
    pq = {(r["qid"], r["k"]): r for r in M.per_query(kept, qrels, (1, 3, 10), run_qids=run).collect()}
    assert all(pq[("q4", k)][m] == 0 for k in (1, 3, 10) for m in M.METRICS)
    means = _means(M.mean(M.per_query(kept, qrels, (1, 3, 10), run_qids=run)))
    assert means[("ndcg", 10)] == pytest.approx(GOLD[10][0] / 2, abs=1e-9)


def test_negative_grades_and_zero_positive_queries(spark):
    run = _df(spark, [("q", "a", 0.9), ("q", "b", 0.5), ("z", "a", 0.3)], "qid string, did string, score double")
    qrels = _df(spark, [("q", "a", -1), ("q", "b", 1), ("z", "a", 0)], "qid string, did string, rel int")
    pq = {(r["qid"], r["k"]): r for r in M.per_query(run, qrels, (1, 2)).collect()}
    assert pq[("q", 2)]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert pq[("q", 2)]["mrr"] == 0.5
    assert all(pq[("z", 2)][m] == 0 for m in M.METRICS)


def test_flagship_golden_numbers(spark):
    """The survey's three-way cross-checked VEC numbers (query subset, all-pairs qrels)."""
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = emb.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    c = emb.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"))
    a, b = emb.alias("a"), emb.alias("b")
    qrels = (
        a.where(F.col("a.vec_id") % 10 == 0).join(b, F.col("a.vec_id") != F.col("b.vec_id"))
        .select(F.col("a.vec_id").cast("string").alias("qid"), F.col("b.vec_id").cast("string").alias("did"),
                F.when(F.col("b.label") == F.col("a.label"), F.when(F.col("b.vec_id") % 3 == 0, 2).otherwise(1))
                .when(F.col("b.label") == (F.col("a.label") + 1) % 10, 0).alias("rel"))
        .where("rel IS NOT NULL")
    )
    run = search(q, c, 10, exclude_identical=True)
    pq = M.per_query(run, qrels, (10,))
    means = _means(M.mean(pq))
    assert pq.count() == 50
    want = dict(ndcg=0.075841025, map=0.007090976, recall=0.021375114, precision=0.104, mrr=0.236103175,
                cv_recall=0.66)
    for m, w in want.items():
        assert means[(m, 10)] == pytest.approx(w, abs=1e-8), m
    na = {(r["metric"], r["signal"]): r["value"] for r in nauc(M.to_long(pq), confidence(run)).collect()}
    assert na[("ndcg", "max")] == pytest.approx(0.09041091, abs=1e-7)
