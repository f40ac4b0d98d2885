"""What leaves the scorer, what is shuffled, and how lists grow."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import candidates as C
from rankwell.operators import prep
from rankwell.operators import score as S
from rankwell.sources import files, json_array

VECS = "id string, grp string, vec array<double>"


def vectors(spark, n, groups, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(f"x{i}", groups[i % len(groups)], r.random(4).tolist()) for i in range(n)], VECS)


def sides(df):
    return df.select(F.col("id").alias("qid"), "grp", "vec"), df.select(F.col("id").alias("did"), "grp", "vec")


def brute(df, k):
    rows = df.collect()
    out = []
    for q in rows:
        a = np.array(q["vec"])
        hits = sorted(((float(S.sort_keys(np.array([a @ np.array(d["vec"]) / np.linalg.norm(a) / np.linalg.norm(d["vec"])]))[0]), d["id"])
                       for d in rows if d["grp"] is not None and d["grp"] == q["grp"]), reverse=True)[:k]
        out += [(q["id"], did, i) for i, (_, did) in enumerate(hits, 1)]
    return sorted(out)


def test_deep_search_emits_k_rows_per_query(spark, tmp_path):
    """k exceeds a task's share of the corpus: the queries are divided, not the corpus."""
    vectors(spark, 600, ["a"]).write.parquet(str(tmp_path / "v"))  # a table of known size
    q, c = sides(spark.read.parquet(str(tmp_path / "v")))
    pairs = S._pairs_global(q, c.drop("grp"), 600, 4, 300, 1 << 20, False, None)
    partial = pairs.select("blk", "q_items", "c_items").mapInArrow(S._scorer(300, True, False, [], False), "qid string, did string, score double")
    assert partial.count() == 600 * 300  # once, not once per task
    assert pairs.select("blk").distinct().count() == spark.sparkContext.defaultParallelism
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = S.search(q, c, 300).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("rk").alias("m")).collect()
    assert len(got) == 600 and all(r["n"] == r["m"] == 300 for r in got)


def test_deep_search_equals_the_other_plan(spark, monkeypatch, tmp_path):
    vectors(spark, 90, ["a"], 3).write.parquet(str(tmp_path / "v"))
    q, c = sides(spark.read.parquet(str(tmp_path / "v")))
    deep = sorted(map(tuple, S.search(q.limit(7), c, 400).select("qid", "did", "rk").collect()))
    monkeypatch.setattr(S, "DEEP_K", 1 << 30)
    assert deep == sorted(map(tuple, S.search(q.limit(7), c, 400).select("qid", "did", "rk").collect()))


@pytest.mark.parametrize("local", [64, 0])
def test_grouped_search_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(S, "MAX_LOCAL_GROUPS", local)
    df = vectors(spark, 120, ["a", "a", "b", None, "c/d", ""]).repartition(3)
    q, c = sides(df)
    got = S.search(q, c, 5, group_cols=["grp"], chunk_rows=16, query_block_bytes=1024)
    assert sorted(map(tuple, got.select("qid", "did", "rk").collect())) == brute(df, 5)


def test_grouped_search_by_two_columns(spark):
    df = vectors(spark, 60, ["a", "b"]).withColumn("half", F.pmod(F.hash("id"), F.lit(2)))
    both = df.withColumn("grp2", F.concat("grp", F.col("half").cast("string")))
    q = df.select(F.col("id").alias("qid"), "grp", "half", "vec")
    c = df.select(F.col("id").alias("did"), "grp", "half", "vec")
    got = S.search(q, c, 4, group_cols=["grp", "half"])
    assert sorted(map(tuple, got.select("qid", "did", "rk").collect())) == brute(both.drop("grp").withColumnRenamed("grp2", "grp"), 4)


def test_grouped_search_ships_one_corpus_copy(spark, monkeypatch):
    """Few groups: no shuffle of the corpus at all.  Otherwise: each corpus row in exactly one block row."""
    q, c = sides(vectors(spark, 500, ["a"]))
    local = S._pairs_broadcast_groups(q, c, ["grp"], 4, 1024, False)
    plan = local._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    shuffled = S._pairs_grouped(q, c, ["grp"], 4, 1024, 50, False)
    per_block = shuffled.select("cb", F.size("c_items").alias("n")).distinct().groupBy().agg(F.sum("n")).first()[0]
    assert per_block == 500
    lines = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("c_items") and "explode" in lines.lower()


def test_lists_of_a_document_stay_bounded(spark, monkeypatch):
    """One document listed by all queries: no list over ``LIST_BLOCK`` is built, and every pair is scored."""
    monkeypatch.setattr(C, "LIST_BLOCK", 64)
    q, c = sides(vectors(spark, 500, ["a"]))
    cand = q.select("qid", F.lit("x0").alias("did")).unionByName(q.select("qid", F.col("qid").alias("did"))).unionByName(q.limit(3).select("qid", F.lit(None).alias("did")))
    sizes = []
    collect = F.collect_list
    monkeypatch.setattr(C.F, "collect_list", lambda col: sizes.append(col) or collect(col))
    pairs = C.candidate_pairs(cand, q, c)
    assert sizes == ["qid"]
    assert pairs.count() == 999 and pairs.select("qid", "did").distinct().count() == 999
    counts = S._block_counts(cand.where("did is not null").distinct(), ["did"], 32, "shares").collect()
    assert [(r["_shares_did"], r["shares"]) for r in counts] == [("x0", 16)]
    dealt = cand.where("did = 'x0'").distinct().groupBy(F.pmod(F.xxhash64("qid"), F.lit(16))).count().agg(F.max("count")).first()[0]
    assert dealt <= 64


# ---------------------------------------------------------------- sequences
def parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, data string")
    return [r["items"] and [tuple(x) for x in r["items"]] for r in df.withColumn("items", prep.parse_sequence()).orderBy("id").collect()]


def test_sequences(spark):
    got = parse(spark, '["a", {"path": "p.png"}, "{no image", 3, null, {"package": "k", "path": "q"}]', "[]", None, ' [ "x,\\"y]" ] ')
    assert got[0] == [("a", None, None), (None, "p.png", None), ("{no image", None, None), ("3", None, None), (None, None, None), (None, "q", "k")]
    assert got[1:] == [[], None, [('x,"y]', None, None)]]


@pytest.mark.parametrize("bad", ['["x", {"path":', '[["nested"]]', '["a", {"package": "k"}]', "plain", '{"path": "p"}', '["a"] x', '"text"', ""])
def test_malformed_sequences_fail(spark, bad):
    with pytest.raises(Exception, match="cannot be read"):
        parse(spark, '["ok"]', bad)
    rows = spark.createDataFrame([("g", '["ok", null]'), ("b", bad), ("n", None)], "id string, data string")
    errors = prep.sequence_errors(rows).collect()
    assert [r["id"] for r in errors] == ["b"] and errors[0]["position"] in (-1, 0, 1)


@pytest.mark.parametrize("bad", ['{"path":', '{"package": "k"}', "[]", "p.png"])
def test_malformed_images_fail(spark, bad):
    df = spark.createDataFrame([('{"path": "p"}',), (None,)], "data string")
    assert [r[0] and tuple(r[0]) for r in df.select(prep.parse_image_ref()).collect()] == [("p", None), None]
    with pytest.raises(Exception, match="no image path"):
        spark.createDataFrame([(bad,)], "data string").select(prep.parse_image_ref()).collect()


# ---------------------------------------------------------------- JSON arrays over several splits
def lists(n, pad=""):
    return [{"question_id": f"q{i}", "haystack_session_ids": [f'd{i},"{j}]' for j in range(i % 4)], "note": {"x": [1, {"y": "a],b" + pad}]}} for i in range(n)]


def expected(objects):
    last = {o["question_id"]: o["haystack_session_ids"] for o in objects}
    return sorted(((q, d) for q, ds in last.items() for d in (ds or [None])), key=str)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_of_several_splits(spark, tmp_path, indent):
    objects = lists(400) + [{"question_id": "q7", "haystack_session_ids": ["last"]}]
    path = tmp_path / "lists.json"
    path.write_text(json.dumps(objects, indent=indent, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert json_array._fragments(spark, str(path)).rdd.getNumPartitions() > 5
        got = files.read_candidates_json_array(spark, str(path))
        assert sorted(map(tuple, got.collect()), key=str) == expected(objects)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["[]", " [ ] \n", '[{"question_id": "a", "haystack_session_ids": []}]\n'])
def test_small_json_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    got = files.read_candidates_json_array(spark, str(tmp_path / "a.json")).collect()
    assert [tuple(r) for r in got] == ([("a", None)] if "a" in text else [])


def test_element_longer_than_a_split(spark, tmp_path):
    objects = lists(3, "z," * 4000) + lists(2)
    (tmp_path / "a.json").write_text(json.dumps(objects))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert sorted(map(tuple, files.read_candidates_json_array(spark, str(tmp_path / "a.json")).collect()), key=str) == expected(objects)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ['[{"question_id": "a"', '{"question_id": "a"}', '[{"question_id": "a"}] x', 'x [1]', '[{"question_id": "a}]', '[{"question_id": "a",}]'])
def test_malformed_json_arrays_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        files.read_candidates_json_array(spark, str(tmp_path / "a.json")).collect()
