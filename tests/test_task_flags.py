"""Task flags of the lifecycle: identical ids, skip-first, main score, empty subset paths."""

import json

import pytest

from rankwell.plans.evaluate import RetrievalTask, main_score, score_run
from rankwell.sources import files as S


def _means(df):
    return {(r.metric, r.k): r.value for r in df.collect() if ":" not in r.metric}


def test_ignore_identical_and_skip_first(spark):
    run = spark.createDataFrame([("q", "q", 1.0), ("q", "a", 0.9), ("q", "b", 0.8)], "qid string, did string, score double")
    qrels = spark.createDataFrame([("q", "a", 1)], "qid string, did string, rel int")
    plain = _means(score_run(run, qrels, RetrievalTask("t", k_values=(1, 2)), with_nauc=False))
    assert plain[("mrr", 2)] == 0.5
    ident = _means(score_run(run, qrels, RetrievalTask("t", k_values=(1, 2), ignore_identical_ids=True),
                             with_nauc=False))
    assert ident[("mrr", 1)] == 1.0
    skip = _means(score_run(run, qrels, RetrievalTask("t", k_values=(1, 2), skip_first_result=True),
                            with_nauc=False))
    assert skip[("precision", 1)] == 1.0
    m = main_score(score_run(run, qrels, RetrievalTask("t", k_values=(1, 2), main_metric="mrr_at_2"),
                             with_nauc=False), RetrievalTask("t", main_metric="mrr_at_2"))
    assert [(r.main_metric, r.value) for r in m.collect()] == [("mrr_at_2", pytest.approx(0.5))]


def test_nauc_rows_are_named_like_the_reference(spark):
    from rankwell.operators.metrics import metric_name
    from pyspark.sql import functions as F

    run = spark.createDataFrame([(f"q{i}", "a", 0.1 * i) for i in range(1, 6)], "qid string, did string, score double")
    qrels = spark.createDataFrame([(f"q{i}", "a", i % 2) for i in range(1, 6)], "qid string, did string, rel int")
    out = score_run(run, qrels, RetrievalTask("t", k_values=(1,)))
    names = {r.n for r in out.select(metric_name(F.col("metric"), F.col("k")).alias("n")).collect()}
    assert {"ndcg_at_1", "nauc_ndcg_at_1_max", "nauc_mrr_at_1_diff1", "cv_recall_at_1"} <= names


def test_empty_subset_reads_task_root(spark, tmp_path):
    (tmp_path / "queries.jsonl").write_text(json.dumps({"id": "1", "text": "t"}))
    df = S.read_subsets(spark, S.read_queries_jsonl, str(tmp_path), [""], "queries.jsonl")
    assert [(r.subset, r.qid) for r in df.collect()] == [("", "1")]
