"""Audits (J7 / U2), dataset statistics (M15), selection and load counts."""

import pytest

from rankwell.operators.audit import audit_counts, dataset_stats, run_qrels_audit
from rankwell.sources.files import load_counts, select_values


def test_every_audit_check(spark):
    run = spark.createDataFrame([("q1", "a", 1.0), ("q5", "b", 0.5)], "qid string, did string, score double")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "x", 1), ("q3", "y", 0)], "qid string, did string, rel int")
    cand = spark.createDataFrame([("q1", "a"), ("q4", None)], "qid string, did string")
    run_qids = spark.createDataFrame([("q1",), ("q4",), ("q5",)], "qid string")
    got = sorted((r.check, r.qid) for r in run_qrels_audit(run, qrels, cand, run_qids).collect())
    assert got == [("empty_candidates", "q4"), ("empty_hits", "q4"), ("no_positive", "q3"),
                   ("only_in_qrels", "q2"), ("only_in_qrels", "q3"), ("only_in_run", "q5")]
    counts = {r.check: r.n for r in audit_counts(run_qrels_audit(run, qrels, cand, run_qids)).collect()}
    assert counts["only_in_qrels"] == 2


def test_dataset_stats_without_keys(spark):
    q = spark.createDataFrame([("q1", "ab"), ("q2", "abcd")], "qid string, text string")
    c = spark.createDataFrame([("d1", "x"), ("d2", "xyz"), ("d3", "xy")], "did string, text string")
    r = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 0), ("q2", "d3", 2)], "qid string, did string, rel int")
    row = dataset_stats(q, c, r).first()
    assert (row.n_samples, row.num_documents, row.num_queries) == (5, 3, 2)
    assert row.average_query_length == pytest.approx(3.0)
    assert row.average_document_length == pytest.approx(2.0)
    assert row.average_relevant_docs_per_query == pytest.approx(1.0)


def test_selection_and_load_counts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "subset string, v int")
    assert sorted(r.subset for r in select_values(df, "subset", ["a", "c"]).collect()) == ["a", "c"]
    assert select_values(df, "subset", None).count() == 3
    got = {r.side: r.n for r in load_counts({"query": df, "corpus": df.union(df)}).collect()}
    assert got == {"query": 3, "corpus": 6}
