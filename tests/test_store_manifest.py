"""What counts as stored: empty results, killed runs, changed inputs, null subsets."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from rankwell.operators import metrics as M
from rankwell.operators.embed import HashedBagOfWords
from rankwell.plans import evaluate as E
from rankwell.plans import store

ROWS, QRELS = "id string, data string", "qid string, did string, rel int"
TASK = E.RetrievalTask(name="T", k_values=(1, 3))


hashed = partial(HashedBagOfWords, 16)


def _forbidden():
    def factory():
        raise AssertionError("embedded again")

    return factory


forbidden = _forbidden()  # a local function travels to the workers by value


def inputs(spark):
    q = spark.createDataFrame([("q1", "red fox"), ("q2", "blue sea")], ROWS)
    c = spark.createDataFrame([("d1", "a red fox"), ("d2", "the blue sea"), ("d3", "nothing")], ROWS)
    return q, c, spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], QRELS)


def values(df):
    return {(r["subset"], r["metric"], r["k"]): r["value"] for r in df.collect() if not r["metric"].startswith("nauc")}


def test_stored_results_are_used_and_changed_inputs_are_not(spark, tmp_path):
    q, c, rel = inputs(spark)
    out = str(tmp_path / "out")
    first = values(E.evaluate(spark, TASK, "m", hashed, q, c, rel, out))
    assert first["", "recall", 1] == 1.0
    assert values(E.evaluate(spark, TASK, "m", forbidden, q, c, rel, out)) == first
    entries = {(r["stage"], r["subset"]): r["rows"] for r in store.load_manifest(spark, f"{out}/manifest").collect()}
    assert entries["run-full", ""] == 6 and ("metrics", "") in entries
    # other judgments: new metrics from the stored run
    swapped = spark.createDataFrame([("q1", "d2", 1), ("q2", "d1", 1)], QRELS)
    assert values(E.evaluate(spark, TASK, "m", forbidden, q, c, swapped, out))["", "recall", 1] == 0.0
    # one document changes: only it is embedded, and nothing old is served
    changed = c.withColumn("data", F.when(F.col("id") == "d1", "green hill").otherwise(F.col("data")))
    seen = tmp_path / "seen"

    def counting():
        model = HashedBagOfWords(16)

        def run(pdf):
            with open(seen, "a") as f:
                f.write("".join(f"{t}\n" for t in pdf["data"]))
            return model(pdf)

        return run

    got = values(E.evaluate(spark, TASK, "m", counting, q, changed, rel, out))
    assert got["", "recall", 1] == 0.5 and seen.read_text().split("\n")[:-1] == ["green hill"]
    kept = store.load_embeddings(spark, f"{out}/embeddings", "m", "T", "collection")
    assert sorted(r["id"] for r in kept.collect()) == ["d1", "d2", "d3"]


def test_a_killed_embedding_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", f"word{i}") for i in range(60)], ROWS)
    root, calls = str(tmp_path / "emb"), []

    def embed(part, fail_at=None):
        calls.append(part.count())
        if len(calls) == fail_at:
            raise RuntimeError("killed")
        return E.embed_keyed(part, hashed, ["subset", "source"], ["data"])

    with pytest.raises(RuntimeError):
        store.embed_missing(rows, lambda p: embed(p, 3), root, "m", "T", "query", ["data"], chunk_rows=15)
    done = store.load_embeddings(spark, root, "m", "T", "query").count()
    assert 0 < done < 60 and done == sum(calls[:2])
    calls.clear()
    got = store.embed_missing(rows, embed, root, "m", "T", "query", ["data"], chunk_rows=15)
    assert got.count() == 60 == got.select("id").distinct().count() and sum(calls) == 60 - done
    calls.clear()
    assert store.embed_missing(rows, embed, root, "m", "T", "query", ["data"]).count() == 60 and calls == []


@pytest.mark.parametrize("side", ["queries", "corpus", "both"])
def test_empty_sides(spark, tmp_path, side):
    q, c, rel = inputs(spark)
    q, c = (x.limit(0) if side in (name, "both") else x for name, x in (("queries", q), ("corpus", c)))
    out = str(tmp_path / "out")
    got = values(E.evaluate(spark, TASK, "m", hashed, q, c, rel, out))
    assert (set(got.values()) == {0.0}) if side == "corpus" else got == {}
    assert values(E.evaluate(spark, TASK, "m", forbidden, q, c, rel, out)) == got
    assert store.Manifest(spark, f"{out}/manifest", "m", "T").entries("run-full")[""][0] == 0


def test_null_subset_is_the_unnamed_one(spark, tmp_path):
    q, c, rel = (x.withColumn("subset", F.lit(None).cast("string")) for x in inputs(spark))
    more = [x.withColumn("subset", F.lit("s")) for x in inputs(spark)]
    q, c, rel = (a.unionByName(b) for a, b in zip((q, c, rel), more))
    got = values(E.evaluate(spark, TASK, "m", hashed, q, c, rel, str(tmp_path / "out"), by_subset=True))
    assert got["", "recall", 1] == got["s", "recall", 1] == 1.0


def test_a_subset_that_loses_its_hits_is_not_served_from_before(spark, tmp_path):
    q, c, rel = (x.withColumn("subset", F.lit("s")) for x in inputs(spark))
    out = str(tmp_path / "out")
    assert values(E.evaluate(spark, TASK, "m", hashed, q, c, rel, out, by_subset=True))["s", "recall", 1] == 1.0
    assert values(E.evaluate(spark, TASK, "m", hashed, q, c.limit(0), rel, out, by_subset=True))["s", "recall", 1] == 0.0


def test_missing_id_fails(spark, tmp_path):
    q, c, rel = inputs(spark)
    with pytest.raises(Exception, match="missing required field id"):
        E.evaluate(spark, TASK, "m", hashed, q, c.unionByName(spark.createDataFrame([(None, "x")], ROWS)), rel, str(tmp_path / "out"))


def test_integer_ids_beside_nulls_of_other_columns(spark):
    from rankwell.operators.embed import embed

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, data string")
    assert sorted(r["id"] for r in embed(df, hashed).collect()) == ["1", "2", "3"]
    with pytest.raises(Exception, match="missing required field id"):
        embed(spark.createDataFrame([(1, "a"), (None, "b")], "id long, data string"), hashed).collect()


def class_qrels(spark):
    q = spark.createDataFrame([("q1", "x"), ("q2", "y"), ("d3", "y")], "qid string, qclass string")
    d = spark.createDataFrame([("d1", "x"), ("d2", "y"), ("d3", "y")], "did string, dclass string")
    return M.ClassQrels(q, d, spark.createDataFrame([("x", "x", 2), ("y", "y", 1)], "qclass string, dclass string, rel int"))


def test_class_judgments_in_hook_and_denominator(spark, tmp_path):
    q, c, _ = inputs(spark)
    pairs = spark.createDataFrame([("q1", "d1", 2), ("q2", "d2", 1), ("q2", "d3", 1), ("d3", "d2", 1)], QRELS)

    def hook(hits):
        return hits.groupBy().agg(F.sum("rel").cast("double").alias("value")).select(F.lit("graded").alias("metric"), F.lit(3).alias("k"), "value")

    got = [values(E.evaluate(spark, TASK, "m", hashed, q, c, x, str(tmp_path / n), hook=hook, denominator="qrels")) for n, x in (("c", class_qrels(spark)), ("p", pairs))]
    assert got[0] == got[1] and got[0]["", "graded", 3] == 4.0
    by_class, by_pair = class_qrels(spark), M.judgments(pairs)
    assert sorted(r["qid"] for r in by_class.judged_queries([]).collect()) == sorted(r["qid"] for r in by_pair.judged_queries([]).collect())
    hits = spark.createDataFrame([("q1", "d1", 1), ("d3", "d3", 1), ("d3", "d2", 2), ("q9", "d1", 1)], "qid string, did string, rk int")
    read = [sorted((r["qid"], r["did"], r["rel"]) for r in x.grades_of_hits(hits, []).collect()) for x in (by_class, by_pair)]
    assert str(read[0]) == str(read[1])


def test_fingerprints_see_content_not_order(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], ROWS)
    assert store.fingerprints(a) == store.fingerprints(a.orderBy(F.desc("id")).select("data", "id").repartition(3))
    assert store.fingerprints(a) != store.fingerprints(a.fillna(""))
    assert store.fingerprints(a.limit(0)) == {} == store.fingerprints(None)
