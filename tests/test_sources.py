"""File sources (S1-S8), qrels round trips, prompts and sequences."""

import json

import pytest
from pyspark.sql import functions as F

from rankwell.operators.prep import flatten_sequences, parse_image_ref, parse_sequence, resolve_prompts
from rankwell.sources import files as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_fields_duplicates_and_compose(spark, tmp_path):
    p = write(tmp_path / "corpus.jsonl", "\n".join(json.dumps(x) for x in [
        {"docid": "a", "title": "T", "text": "x", "_id": "zz"},
        {"docid": "b", "text": "only text"},
        {"docid": "c", "title": "only title", "text": None},
        {"docid": "a", "title": "", "text": "second a"},
        {"docid": 7, "title": None, "text": ""},
    ]))
    got = {r.did: r.text for r in S.read_corpus_jsonl(spark, p, id_field="docid").collect()}
    assert got == {"a": " second a", "b": " only text", "c": "only title ", "7": " "}


def test_queries_require_fields(spark, tmp_path):
    p = write(tmp_path / "q.jsonl", json.dumps({"query_id": "1", "query": "hi"}) + "\n" + json.dumps({"query_id": "2"}))
    with pytest.raises(Exception):
        S.read_queries_jsonl(spark, p, id_field="query_id", text_field="query").collect()


def test_subset_fanout(spark, tmp_path):
    for sub in ("a", "x/y"):
        (tmp_path / sub).mkdir(parents=True)
        write(tmp_path / sub / "queries.jsonl", json.dumps({"id": sub, "text": "t"}))
    df = S.read_subsets(spark, S.read_queries_jsonl, str(tmp_path), ["a", "x/y"], "queries.jsonl", splits=("test", "dev"))
    assert sorted((r.subset, r.split, r.qid) for r in df.collect()) == [
        ("a", "dev", "a"), ("a", "test", "a"), ("x/y", "dev", "x/y"), ("x/y", "test", "x/y")]


def test_qrels_tsv_quoting_and_last_wins(spark, tmp_path):
    p = write(tmp_path / "q.tsv", 'q1\t"d ""x"" 2"\t1\nq1\td2\t0\nq1\td2\t3\n')
    got = sorted((r.qid, r.did, r.rel) for r in S.read_qrels_tsv(spark, p).collect())
    assert got == [("q1", 'd "x" 2', 1), ("q1", "d2", 3)]


def test_qrels_tsv_bad_score_fails(spark, tmp_path):
    p = write(tmp_path / "bad.tsv", "q1\td1\tx\n")
    with pytest.raises(Exception):
        S.read_qrels_tsv(spark, p).collect()


def test_qrels_strict_tsv(spark, tmp_path):
    p = write(tmp_path / "ok.tsv", "q1\td1\t1 \r\n  q2\td2\t2\n")
    assert sorted((r.qid, r.did, r.rel) for r in S.read_qrels_tsv_strict(spark, p).collect()) == [
        ("q1", "d1", 1), ("q2", "d2", 2)]
    bad = write(tmp_path / "bad.tsv", "q1\td1\n")
    with pytest.raises(Exception):
        S.read_qrels_tsv_strict(spark, bad).collect()


def test_json_qrels_round_trip(spark):
    q = spark.createDataFrame([("q1", "b", 1), ("q1", "a", 2), ("q2", "c", 0)], "qid string, did string, rel int")
    packed = S.qrels_to_json_rows(q)
    assert {r.id: r.data for r in packed.collect()} == {"q1": '{"a":2,"b":1}', "q2": '{"c":0}'}
    back = S.qrels_from_json_rows(packed)
    assert sorted(back.collect()) == sorted(q.collect())


def test_candidate_sources(spark, tmp_path):
    p = write(tmp_path / "c.jsonl", "\n".join(json.dumps(x) for x in [
        {"query_id": "q1", "candidate_doc_ids": ["a", "b"]},
        {"query_id": "q2", "candidate_doc_ids": []},
        {"query_id": "q1", "candidate_doc_ids": ["c"]},
    ]))
    got = sorted((r.qid, r.did or "") for r in S.read_candidates_jsonl(spark, p).collect())
    assert got == [("q1", "c"), ("q2", "")]
    arr = write(tmp_path / "m.json", json.dumps([
        {"question_id": "x", "haystack_session_ids": ["s1", "s2"]},
        {"question_id": "y", "haystack_session_ids": ["s3"]}], indent=1))
    got = sorted((r.qid, r.did) for r in S.read_candidates_json_array(spark, arr).collect())
    assert got == [("x", "s1"), ("x", "s2"), ("y", "s3")]


def test_dataset_rows(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", "\n".join(json.dumps(x) for x in [
        {"id": 1, "data": "hello", "modal": "TEXT", "prompt": "p"},
        {"id": 2, "data": json.dumps({"path": "a.png"}), "modal": "IMAGE"},
        {"id": 3, "data": json.dumps(["look", {"path": "b.png", "package": "p2"}, "there"]), "modal": "SEQ"},
    ]))
    df = S.read_dataset(spark, p, "MIXED", with_prompt=True)
    assert df.columns == ["id", "data", "prompt", "modal"]
    img = df.where("modal = 'IMAGE'").select(parse_image_ref().alias("r")).first().r
    assert (img.path, img.package) == ("a.png", None)
    seq = flatten_sequences(df.where("modal = 'SEQ'").select(parse_sequence().alias("items")), "items").first()
    assert seq.seq_text == "look there "
    assert (seq.seq_image.path, seq.seq_image.package) == ("b.png", "p2")


def test_prompt_priority(spark):
    rows = spark.createDataFrame([("1", "T1", "Retrieval", "query"), ("2", "T2", "Retrieval", "query"),
                                  ("3", "T2", "Other", "document"), ("4", "T9", "Other", "query")],
                                 "id string, task string, task_type string, side string")
    prompts = [("task_side", "T1", "query", "ts"), ("task", "T1", None, "t"), ("type_side", "Retrieval", "query", "ys"),
               ("type", "Other", None, "y"), ("side", None, "query", "s"), ("side", None, "document", "d")]
    got = {r.id: r.prompt for r in resolve_prompts(rows, prompts).collect()}
    assert got == {"1": "ts", "2": "ys", "3": "y", "4": "y"}
    only_side = {r.id: r.prompt for r in resolve_prompts(rows, [("side", None, "document", "d")]).collect()}
    assert only_side == {"1": None, "2": None, "3": "d", "4": None}
