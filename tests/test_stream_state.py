"""Incremental top-k on keyed state: only changes are written, the state is the result."""

import numpy as np

from rankwell.operators.score import search
from rankwell.streaming.topk import changes, rankings, run_to_table, stream_topk

VECS = "did string, vec array<double>"


def corpus(n, seed=1):
    r = np.random.default_rng(seed)
    return [(f"d{i}", r.random(4).tolist()) for i in range(n)]


def deliver(spark, folder, number, rows):
    spark.createDataFrame(rows, VECS).coalesce(1).write.parquet(f"{folder}/part={number}")


def run(spark, folder, queries, base, k=3):
    stream = spark.readStream.schema(VECS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return run_to_table(stream_topk(stream, queries, k), out_dir=f"{base}/out", checkpoint=f"{base}/checkpoint")


def shown(df):
    return sorted((r["qid"], r["did"], round(r["score"], 9), r["rk"]) for r in df.select("qid", "did", "score", "rk").collect())


def test_only_changes_are_written(spark, tmp_path):
    rows = corpus(40)
    queries = spark.createDataFrame([(f"q{i}", [1.0 * (i == j) + 0.1 for j in range(4)]) for i in range(4)], "qid string, vec array<double>")
    folder, base = str(tmp_path / "in"), str(tmp_path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    deliver(spark, folder, 0, rows[:25])
    first = shown(run(spark, folder, queries, base))
    deliver(spark, folder, 1, rows[:25])  # delivered again: changes nothing
    assert shown(run(spark, folder, queries, base)) == first
    batches = {r["batch"]: r["count"] for r in changes(spark, f"{base}/out").groupBy("batch").count().collect()}
    assert batches == {0: 12}  # the second micro-batch wrote no row
    better = [("e0", [1.1, 0.1, 0.1, 0.1])]  # the best document of one query only
    deliver(spark, folder, 2, better)
    last = shown(run(spark, folder, queries, base))
    moved = changes(spark, f"{base}/out").where("batch = 2")
    assert {r["qid"] for r in moved.collect()} == {"q0"} and moved.count() == 3
    everything = spark.createDataFrame(rows[:25] + better, VECS)
    assert last == shown(search(queries, everything, 3))
    assert shown(rankings(spark, f"{base}/checkpoint")) == last  # read again from the state alone
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_many_batches_equal_one(spark, tmp_path):
    rows = corpus(60, 2)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(corpus(5, 3))], "qid string, vec array<double>")
    for i in range(3):
        deliver(spark, str(tmp_path / "in"), i, rows[i * 20:(i + 1) * 20] + rows[:2])
    got = run(spark, str(tmp_path / "in"), queries, str(tmp_path), k=7)
    assert shown(got) == shown(search(queries, spark.createDataFrame(rows, VECS), 7))


def test_a_retried_batch_replaces_its_output(spark, tmp_path):
    """The commit of the last micro-batch is lost: it runs again from the state before it and writes the same rows."""
    rows = corpus(30, 4)
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.2, 0.1])], "qid string, vec array<double>")
    for i in range(2):
        deliver(spark, str(tmp_path / "in"), i, rows[i * 15:(i + 1) * 15])
    final = shown(run(spark, str(tmp_path / "in"), queries, str(tmp_path)))
    written = sorted(map(tuple, changes(spark, f"{tmp_path}/out").collect()))
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint" / "commits").iterdir():
        if p.name in (str(last), f".{last}.crc"):
            p.unlink()
    assert shown(run(spark, str(tmp_path / "in"), queries, str(tmp_path))) == final
    assert sorted(map(tuple, changes(spark, f"{tmp_path}/out").collect())) == written


def test_no_batch_has_no_rankings(spark, tmp_path):
    assert rankings(spark, str(tmp_path / "none")).collect() == []


def test_a_batch_of_one_file_is_scored_by_many_tasks(spark):
    from rankwell.streaming import topk as T

    n = min(2 * spark.sparkContext.defaultParallelism, 8)
    rows = corpus(4096, 5)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(rows)], "qid string, vec array<double>")
    chunks = T.pack_partitions(spark.createDataFrame(rows, VECS).coalesce(1), ["did", "vec"], out="c_items")
    pairs = T._pairs(queries, chunks, 4096, 96, 3, 16 << 20)
    assert pairs.rdd.getNumPartitions() >= n
    assert pairs.count() == pairs.select("blk").distinct().count() == n  # a query's hits leave one task


def test_state_is_kept_by_teams_of_queries(spark, tmp_path, monkeypatch):
    from rankwell.streaming import topk as T

    monkeypatch.setattr(T, "STATE_TEAMS", 2)
    rows = corpus(30, 6)
    queries = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(corpus(9, 7))], "qid string, vec array<double>")
    deliver(spark, str(tmp_path / "in"), 0, rows)
    got = run(spark, str(tmp_path / "in"), queries, str(tmp_path))
    assert shown(got) == shown(search(queries, spark.createDataFrame(rows, VECS), 3))
    with T.state_settings(spark):
        state = spark.read.format("statestore").option("stateVarName", "top").load(f"{tmp_path}/checkpoint")
        assert state.select("key").distinct().count() == 2 and state.count() == 9
