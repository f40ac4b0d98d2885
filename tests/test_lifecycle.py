"""Cases of the lifecycle and its sources: lost queries, depth, resume per subset, strict inputs, scales, class judgments."""

import io
import json
import sys
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankwell.operators import metrics as M
from rankwell.operators.contains import contains_pairs
from rankwell.operators.fusion import fuse, jaccard_scorer, token_overlap
from rankwell.operators.rank import top_k
from rankwell.operators.score import _pairs_grouped, search, sort_keys
from rankwell.functions.vectors import sort_key
from rankwell.plans import store
from rankwell.plans.evaluate import RetrievalTask, evaluate, pair_retriever, prompted
from rankwell.session import _SCRATCH, drop_scratch, scratch_path
from rankwell.sources import files, packages
from rankwell.sources.task_files import load_task


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def letters():
    """Embedder of one-letter texts: orthogonal unit vectors."""

    def embed(inputs):
        return np.array([[float(c in (t or "")) for c in "abcdefgh"] for t in inputs.iloc[:, 0]])

    return embed


def never():
    raise RuntimeError("must not be embedded again")


def table(spark, rows, schema="id string, data string"):
    return spark.createDataFrame(rows, schema)


def values(df, *keys):
    return {tuple(r[k] for k in (*keys, "metric", "k")): r.value for r in df.collect() if not r.metric.startswith("nauc_")}


QRELS = "qid string, did string, rel int"


def test_passages_with_equal_ids_and_other_texts(spark):
    docs = spark.createDataFrame([("d1", "the alpha text"), ("d2", "a gamma text")], "did string, text string")
    for word, want in (("alpha", "d1"), ("gamma", "d2"), ("alpha", "d1")):
        passages = spark.createDataFrame([("1", word)], "pid string, text string")
        assert [(r.pid, r.did) for r in contains_pairs(docs, passages).collect()] == [("1", want)]


def test_queries_without_hits_count_with_zeros(spark, tmp_path):
    q, c = table(spark, [("1", "a"), ("2", "b")]), table(spark, [("x", "a"), ("y", "b")])
    qrels = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], QRELS)
    lists = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", None)], "qid string, did string")
    got = values(evaluate(spark, RetrievalTask("t", k_values=(1,)), "m", letters, q, c, qrels, str(tmp_path / "a"), candidates=lists))
    assert got[("recall", 1)] == 0.5
    # and if nothing at all is found
    none = spark.createDataFrame([("1", None), ("2", None)], "qid string, did string")
    got = values(evaluate(spark, RetrievalTask("u", k_values=(1,)), "m", letters, q, c, qrels, str(tmp_path / "a"), candidates=none))
    assert got[("recall", 1)] == 0.0
    # hits that the task itself removes leave the query in the denominator too
    same = spark.createDataFrame([("1", "1", 1), ("2", "y", 1)], QRELS)
    run = spark.createDataFrame([("1", "1", 0.9), ("2", "y", 0.8)], "qid string, did string, score double")
    from rankwell.plans.evaluate import score_run

    got = values(score_run(run, same, RetrievalTask("t", k_values=(1,), ignore_identical_ids=True), with_nauc=False))
    assert got[("recall", 1)] == 0.5


def test_strict_lists_fail_for_a_query_without_one(spark, tmp_path):
    q, c = table(spark, [("1", "a"), ("2", "b")]), table(spark, [("x", "a")])
    lists = spark.createDataFrame([("1", "x")], "qid string, did string")
    qrels = spark.createDataFrame([("1", "x", 1)], QRELS)
    with pytest.raises(Exception, match="missing from the candidate map"):
        evaluate(spark, RetrievalTask("t"), "m", letters, q, c, qrels, str(tmp_path / "a"), candidates=lists, strict_candidates=True)


@pytest.mark.parametrize("identical", [False, True])
def test_removed_hits_are_searched_for_in_addition(spark, tmp_path, identical):
    q = table(spark, [("1", "ab")])
    c = table(spark, [("1", "ab"), ("x", "ab"), ("y", "a"), ("z", "b"), ("w", "c")])
    qrels = spark.createDataFrame([("1", d, 1) for d in ("1", "x", "y", "z")], QRELS)
    task = RetrievalTask("t", k_values=(1, 2), skip_first_result=True, ignore_identical_ids=identical)
    got = values(evaluate(spark, task, "m", letters, q, c, qrels, str(tmp_path / "a")))
    assert got[("precision", 2)] == 1.0


def test_a_subset_added_later_is_evaluated_alone(spark, tmp_path):
    rows = [("s", "1", "a"), ("t", "1", "b"), ("with/slash", "1", "c"), ("", "1", "d")]
    schema = "subset string, id string, data string"
    q, c = spark.createDataFrame(rows, schema), spark.createDataFrame([(s, "x", d) for s, _, d in rows], schema)
    qrels = spark.createDataFrame([(s, "1", "x", 1) for s, _, _ in rows], "subset string, " + QRELS)
    out, task = str(tmp_path / "o"), RetrievalTask("t", k_values=(1,))
    first = evaluate(spark, task, "org/model", letters, q, c, qrels, out, by_subset=True, subsets=["s"])
    assert {r.subset for r in first.collect()} == {"s"}

    def others():
        inner = letters()

        def embed(inputs):
            if any("a" in t for t in inputs.iloc[:, 0]):
                raise RuntimeError("subset s must not be embedded again")
            return inner(inputs)

        return embed

    both = values(evaluate(spark, task, "org/model", others, q, c, qrels, out, by_subset=True), "subset")
    assert {k[0] for k in both} == {"s", "t", "with/slash", ""} and all(both[(s, "recall", 1)] == 1.0 for s, _, _ in rows)
    again = evaluate(spark, task, "org/model", never, q, c, qrels, out, by_subset=True, subsets=["t"])
    assert {r.subset for r in again.collect()} == {"t"}
    assert store.stored_subsets(store.load_run(spark, f"{out}/runs", "org/model", "t")) == {"s", "t", "with/slash", ""}


def test_a_lost_stage_is_computed_from_the_one_before(spark, tmp_path):
    q, c = table(spark, [("1", "a")]), table(spark, [("x", "a")])
    qrels = spark.createDataFrame([("1", "x", 1)], QRELS)
    out, task = str(tmp_path / "o"), RetrievalTask("t", k_values=(1,))
    evaluate(spark, task, "m", letters, q, c, qrels, out)
    drop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/metrics")
    drop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(drop, True)
    assert values(evaluate(spark, task, "m", never, q, c, qrels, out))[("recall", 1)] == 1.0


def test_pair_scorer_and_own_search(spark, tmp_path):
    q, c = table(spark, [("1", "red apple")]), table(spark, [("x", "red car"), ("y", "red apple pie"), ("z", "sky")])
    qrels = spark.createDataFrame([("1", "y", 1)], QRELS)
    lists = spark.createDataFrame([("1", d) for d in "xyz"], "qid string, did string")
    task = RetrievalTask("t", k_values=(1,))
    got = values(evaluate(spark, task, "pairs", None, q, c, qrels, str(tmp_path / "o"), candidates=lists, retriever=pair_retriever(jaccard_scorer)))
    assert got[("mrr", 1)] == 1.0

    def fixed(queries, corpus, depth, candidates, keys):
        return queries.select(F.col("id").alias("qid"), F.lit("y").alias("did"), F.lit(1.0).alias("score"))

    assert values(evaluate(spark, task, "own", None, q, c, qrels, str(tmp_path / "o"), retriever=fixed))[("mrr", 1)] == 1.0


def test_prompts_in_front_of_the_texts(spark):
    df = spark.createDataFrame([("1", "text", None), ("2", "text", "own: ")], "id string, data string, prompt string")
    task = RetrievalTask("T")
    got = {r.id: r.data for r in prompted(df, "query", task, [("task", "T", None, "task: ")], "Retrieval").collect()}
    assert got == {"1": "task: text", "2": "own: text"}
    got = prompted(df.drop("prompt"), "document", task, [("type_side", "Retrieval", "document", "doc: ")], "Retrieval")
    assert {r.data for r in got.collect()} == {"doc: text"}
    assert prompted(df.drop("prompt"), "query", task, None, "Retrieval").columns == ["id", "data"]


# ---------------------------------------------------------------- sources
def test_last_member_of_a_tar_wins(spark, tmp_path):
    path = str(tmp_path / "p.tar")
    with tarfile.open(path, "w") as tf:
        for data in (b"old", b"newer"):
            info = tarfile.TarInfo("x.png")
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    refs = spark.createDataFrame([("1", "x.png", "p")], "id string, path string, package string")
    for indexed in (False, True):  # from the headers, then from the index
        members = packages.read_members(spark, {"p": f"file://{path}"})
        assert [bytes(r.content) for r in packages.fetch(refs, members, {"p": f"file://{path}"}).collect()] == [b"newer"]
        if not indexed:
            packages.write_index(members, "p", path)
    twice = members.union(members.withColumn("offset", F.lit(0).cast("long")))
    assert packages.fetch(refs, twice, {"p": path}).count() == 1


def test_malformed_json_fails(spark, tmp_path):
    bad = spark.createDataFrame([("1", '{"a": 1}'), ("2", '{"a": ')], "id string, data string")
    with pytest.raises(Exception):
        files.qrels_from_json_rows(bad).collect()
    with pytest.raises(Exception):
        files.qrels_from_json_rows(spark.createDataFrame([(None, '{"a": 1}')], "id string, data string")).collect()
    rows = spark.createDataFrame([("1", '{"a": 1}'), ("1", '{"b": 2}')], "id string, data string").coalesce(1)
    assert [(r.qid, r.did, r.rel) for r in files.qrels_from_json_rows(rows).collect()] == [("1", "b", 2)]
    path = tmp_path / "c.jsonl"
    path.write_text('{"query_id": "1", "candidate_doc_ids": ["a"]}\n{"query_id": "2", "candid')
    with pytest.raises(Exception):
        files.read_candidates_jsonl(spark, str(path)).collect()
    path.write_text('{"candidate_doc_ids": ["a"]}')
    with pytest.raises(Exception):
        files.read_candidates_jsonl(spark, str(path)).collect()
    for reader in (files.read_queries_jsonl, files.read_corpus_jsonl):
        path.write_text('{"id": "1", "text": "a"}\n{"id": "2", "te')
        with pytest.raises(Exception):
            reader(spark, str(path)).collect()


def test_task_files_of_both_styles(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "1", "data": "text"}))
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "x", "text": "body"}))
    (tmp_path / "l.tsv").write_text("1\tx\t2\n")
    (tmp_path / "l.jsonl").write_text(json.dumps({"id": "1", "data": '{"x": 2}'}))
    for label in ({"path": f"{tmp_path}/l.tsv", "modal": "LABEL", "xjx_style": True}, {"path": f"{tmp_path}/l.jsonl", "modal": "LABEL"}):
        task = RetrievalTask.from_dict({"name": "T", "unknown": 1, "data": {
            "query": {"path": "json", "modal": "TEXT", "load_kwargs": {"data_files": {"train": [f"{tmp_path}/q.jsonl"]}}},
            "collection": {"path": f"{tmp_path}/c.jsonl", "modal": "TEXT", "xjx_style": True}, "label": label}})
        data = load_task(spark, task)
        assert [tuple(r) for r in data.queries.collect()] == [("1", "text")]
        assert [tuple(r) for r in data.corpus.collect()] == [("x", "body")]
        assert [tuple(r) for r in data.qrels.collect()] == [("1", "x", 2)]
    with pytest.raises(ValueError, match="packages"):
        load_task(spark, RetrievalTask("T", {**task.data, "query": {**task.data["query"], "modal": "MIXED"}}))


# ---------------------------------------------------------------- scores, ranks
def test_small_and_large_products_keep_their_order(spark):
    q = spark.createDataFrame([("q", [1.0])], "qid string, vec array<double>")
    for scale in (1e-150, 1e-12, 1.0, 1e12, 1e150):
        c = spark.createDataFrame([("a", [3 * scale]), ("b", [2 * scale]), ("c", [2 * scale]), ("z", [scale])], "did string, vec array<double>")
        got = search(q, c, 3, do_norm=False).orderBy("rk").collect()
        assert [r.did for r in got] == ["a", "c", "b"] and got[0].score == 3 * scale


def test_sort_key_is_the_same_in_both_places(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=200) * 10.0 ** r.integers(-30, 30, 200), [0.0, -0.0, 1.0, 2.0**-40, -1.0, np.inf]])
    df = spark.createDataFrame([(float(v),) for v in x], "s double").select("s", sort_key("s").alias("k"))
    rows = df.collect()
    assert np.array_equal(sort_keys(np.array([a.s for a in rows])), np.array([a.k for a in rows]))
    assert sort_keys(np.array([0.1 + 0.2]))[0] == sort_keys(np.array([0.3]))[0]


def test_deep_cuts_leave_the_session_alone(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    run = spark.createDataFrame([("q", f"d{i}", float(i)) for i in range(20)], "qid string, did string, score double")
    assert top_k(run, 5000).count() == 20 and spark.conf.get(name) == before


def test_a_task_emits_at_most_k_hits_per_query(spark):
    from rankwell.operators.score import _pairs_global, _scorer

    r = np.random.default_rng(2)
    c = spark.createDataFrame([(f"d{i}", r.normal(size=4).tolist()) for i in range(2000)], "did string, vec array<double>").coalesce(1)
    q = c.limit(30).withColumnRenamed("did", "qid")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pairs = _pairs_global(q, c, 30, 4, 5, 1 << 20, False, None).select("blk", "q_items", "c_items")
        tasks = pairs.rdd.getNumPartitions()
        assert pairs.count() >= 20  # chunks
        hits = pairs.mapInArrow(_scorer(5, True, False, [], False), "qid string, did string, score double").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert hits <= 30 * 5 * tasks


def test_a_group_hot_on_the_query_side_is_spread(spark):
    r = np.random.default_rng(3)
    q = spark.createDataFrame([(f"q{i}", "hot" if i < 400 else f"g{i % 50}", r.random(4).tolist()) for i in range(600)], "qid string, grp string, vec array<double>")
    c = spark.createDataFrame([(f"d{i}", "hot" if i < 10 else f"g{i % 50}", r.random(4).tolist()) for i in range(200)], "did string, grp string, vec array<double>")
    pairs = _pairs_grouped(q, c, ["grp"], 4, 1600, 4096, False).where("grp = 'hot'")
    assert pairs.select("qb", "cb").distinct().count() == pairs.count() >= 20
    got = search(q, c, 3, group_cols=["grp"], query_block_bytes=1600)
    assert got.where("grp = 'hot'").count() == 1200


def test_token_overlap_equals_the_example_scorer(spark):
    rows = [("a b", "b c"), ("", None), ("a A", "a"), ("x", "y z")]
    df = spark.createDataFrame(rows, "q_text string, d_text string").select("q_text", "d_text", token_overlap().alias("s"))
    got = df.toPandas()
    assert np.allclose(got["s"], jaccard_scorer()(got["q_text"], got["d_text"]))


def test_fusion_needs_the_same_ids(spark):
    a = spark.createDataFrame([("1", [1.0]), ("2", [1.0])], "id string, vec array<double>")
    assert fuse(a, a).count() == 2
    for x, y in ((a, a.where("id = '1'")), (a.where("id = '1'"), a)):
        with pytest.raises(Exception, match="one side only"):
            fuse(x, y).collect()


# ---------------------------------------------------------------- judgments
def test_class_judgments_equal_pairs(spark):
    r = np.random.default_rng(4)
    n = 60
    cls = r.integers(0, 4, n)
    grade = lambda q, d: {0: 2, 1: 0}.get((int(cls[d]) - int(cls[q])) % 4) if cls[d] != 3 or cls[q] != 3 else 1
    pairs = [(f"q{i}", f"q{j}", grade(i, j)) for i in range(n) for j in range(n) if i != j and grade(i, j) is not None]
    run = spark.createDataFrame([(f"q{i}", f"q{j}", float(r.random())) for i in range(0, n, 2) for j in r.choice(n, 20, replace=False) if i != j], "qid string, did string, score double")
    rules = sorted({(str(cls[i]), str(cls[j]), grade(i, j)) for i in range(n) for j in range(n) if grade(i, j) is not None})
    by_class = M.ClassQrels(
        spark.createDataFrame([(f"q{i}", str(cls[i])) for i in range(n)], "qid string, qclass string"),
        spark.createDataFrame([(f"q{i}", str(cls[i])) for i in range(n)], "did string, dclass string"),
        spark.createDataFrame(rules, "qclass string, dclass string, rel int"))
    want = M.per_query(run, spark.createDataFrame(pairs, QRELS), (1, 5, 10)).toPandas().sort_values(["qid", "k"]).reset_index(drop=True)
    got = M.per_query(run, by_class, (1, 5, 10)).toPandas().sort_values(["qid", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, atol=1e-12)


def test_metric_plan_reads_judgments_once_and_cuts_the_run(spark, tmp_path):
    spark.createDataFrame([("q", "a", 1)], QRELS).write.parquet(str(tmp_path / "qrels"))
    spark.createDataFrame([("q", "a", 0.5)], "qid string, did string, score double").write.parquet(str(tmp_path / "run"))
    qrels, run = spark.read.parquet(str(tmp_path / "qrels")), spark.read.parquet(str(tmp_path / "run"))
    df = M.per_query(run, qrels, (1, 10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "FileScan parquet" in x]
    # the file location is abbreviated in the plan, so the tables are told apart by their columns
    assert len([x for x in lines if "ReadSchema" in x and "rel:int" in x]) == 1 and len(lines) == 2
    assert plan.count("WindowGroupLimit") >= 2


def test_scratch_folders_can_be_dropped(spark):
    mine = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    path = scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) == 1 and not store._exists(spark, path)
    _SCRATCH[spark.sparkContext.applicationId] = mine
