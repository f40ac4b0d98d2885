"""Tar packages, streaming top-k, result stores and the evaluation lifecycle."""

import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators.embed import HashedBagOfWords, embed, hashed_embedding
from rankwell.operators.fusion import fuse
from rankwell.operators.nauc import nauc
from rankwell.operators.positions import positions
from rankwell.operators.score import search
from rankwell.plans import store
from rankwell.plans.evaluate import RetrievalTask, evaluate
from rankwell.sources import packages as P
from rankwell.streaming.topk import changes, run_to_table, stream_topk

SF01 = "/root/testdata/sf0.01"


def make_tar(path, members):
    with tarfile.open(path, "w") as tf:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
        d = tarfile.TarInfo("folder")
        d.type = tarfile.DIRTYPE
        tf.addfile(d)


def test_packages_index_fetch(spark, tmp_path):
    a, b = str(tmp_path / "a.tar"), str(tmp_path / "b.tar")
    make_tar(a, {"x.png": b"xx-bytes", "y.png": b"y"})
    make_tar(b, {"x.png": b"other"})
    pk = {"imgs": a, "more": b}
    members = P.read_members(spark, pk)
    assert sorted((r.package, r.path) for r in members.collect()) == [("imgs", "x.png"), ("imgs", "y.png"),
                                                                       ("more", "x.png")]
    P.write_index(members, "imgs", a)
    again = P.read_members(spark, pk)  # index file now used for "imgs"
    assert sorted(again.collect()) == sorted(members.collect())
    refs = spark.createDataFrame([("1", "x.png", None), ("2", "x.png", "more"), ("3", "y.png", "")],
                                 "id string, path string, package string")
    refs = P.resolve_refs(refs, "imgs")
    got = {r.id: bytes(r.content) for r in P.fetch(refs, members, pk).collect()}
    assert got == {"1": b"xx-bytes", "2": b"other", "3": b"y"}
    bad = spark.createDataFrame([("9", "nope.png", "imgs")], "id string, path string, package string")
    assert P.missing_refs(bad, members).count() == 1
    assert P.fetch(bad, members, pk, strict=False).first().content is None
    with pytest.raises(Exception):
        P.fetch(bad, members, pk).collect()


def test_stream_topk_equals_batch(spark, tmp_path):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    src = str(tmp_path / "src")
    emb.repartition(4).write.parquet(src)  # 4 files -> 4 micro-batches
    q = emb.select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vec"))
    stream = (spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1).parquet(src)
              .select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec")))
    final = run_to_table(stream_topk(stream, q, 5), out_dir=str(tmp_path / "out"),
                         checkpoint=str(tmp_path / "ck"))
    batch = search(q, emb.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec")), 5)
    assert sorted(final.collect()) == sorted(batch.select("qid", "did", "score", "rk").collect())
    written = changes(spark, str(tmp_path / "out"))  # per micro-batch only rankings that it changed, no snapshots
    assert written.groupBy("batch", "qid").count().where("count > 5").count() == 0
    assert written.count() < 4 * batch.count()


def test_hashed_embedding_jvm_equals_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("data"))
    jvm = {r.id: r.vec for r in hashed_embedding(docs, "data", 32).collect()}
    py = {r.id: r.vec for r in embed(docs, lambda: HashedBagOfWords(32)).collect()}
    assert jvm.keys() == py.keys()
    assert all(np.allclose(jvm[k], py[k]) for k in jvm)


def test_fusion_length_check(spark):
    a = spark.createDataFrame([("1", [1.0, 2.0]), ("2", [1.0])], "id string, vec array<double>")
    b = spark.createDataFrame([("1", [0.5, 0.5]), ("2", [1.0, 1.0])], "id string, vec array<double>")
    assert fuse(a.where("id = '1'"), b).first().vec == [1.5, 2.5]
    with pytest.raises(Exception):
        fuse(a, b).collect()


def _np_nauc(conf, metric):
    rates = np.linspace(0, 1, 11)[:-1]

    def curve(c, m):
        order = np.lexsort((np.arange(len(c)), c))
        out = []
        for r in rates:
            n = min(round(r * len(order)), len(c) - 1)
            out.append(m[order[n:]].mean())
        return np.array(out)

    ab, orc = curve(conf, metric), curve(metric, metric)
    auc, oauc = np.trapezoid(ab, rates), np.trapezoid(orc, rates)
    flat = orc[0] * (rates[-1] - rates[0])
    return None if abs(oauc - flat) < 1e-12 else (auc - flat) / (oauc - flat)


def test_nauc_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 37
    metric = np.round(rng.random(n), 3)
    conf = np.round(rng.random(n), 2)
    qids = [f"q{i:03d}" for i in range(n)]
    pq = spark.createDataFrame([(q, "ndcg", 10, float(m)) for q, m in zip(qids, metric)],
                               "qid string, metric string, k int, value double")
    cf = spark.createDataFrame([(q, float(c), 0.0, 0.0) for q, c in zip(qids, conf)],
                               "qid string, max double, std double, diff1 double")
    got = {r.signal: r.value for r in nauc(pq, cf).collect()}
    assert got["max"] == pytest.approx(_np_nauc(conf, metric), abs=1e-9)


def test_positions_distributed(spark):
    df = spark.range(0, 500).select(F.pmod(F.col("id") * 7, F.lit(3)).alias("g"), (F.col("id") * 13 % 101).alias("v"),
                                    F.col("id"))
    got = positions(df.repartition(6), ["g"], [F.col("v"), F.col("id")]).toPandas()
    pdf = df.toPandas().sort_values(["g", "v", "id"])
    pdf["want"] = pdf.groupby("g").cumcount()
    m = got.merge(pdf, on=["g", "v", "id"])
    assert (m.pos == m.want).all() and len(m) == 500


def test_lifecycle_caches_every_stage(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("data"))
    queries = corpus.limit(20)
    qrels = queries.select(F.col("id").alias("qid"), F.col("id").alias("did"), F.lit(1).alias("rel"))
    task = RetrievalTask(name="self", k_values=(1, 5))
    out = str(tmp_path / "out")
    m1 = evaluate(spark, task, "hashed", lambda: HashedBagOfWords(16), queries, corpus, qrels, out)
    vals = {(r.metric, r.k): r.value for r in m1.collect()}
    assert vals[("recall", 5)] == pytest.approx(1.0)
    assert store.load_run(spark, f"{out}/runs", "hashed", "self") is not None
    assert store.load_embeddings(spark, f"{out}/embeddings", "hashed", "self", "query").count() == 20
    m2 = evaluate(spark, task, "hashed", lambda: (_ for _ in ()).throw(RuntimeError("not cached")),
                  queries, corpus, qrels, out)
    assert sorted(m2.collect()) == sorted(m1.collect())
    plan = spark.createDataFrame([("hashed", "self", ""), ("hashed", "other", "")], "model string, task string, subset string")
    done = store.load_metrics(spark, f"{out}/metrics", "hashed", "self").withColumn("model", F.lit("hashed")).withColumn(
        "task", F.lit("self"))
    assert [r.task for r in store.pending(plan, done).collect()] == ["other"]
    wide = store.wide_metrics(done).first().asDict()
    assert "ndcg_at_5" in wide and "nauc_ndcg_at_5_max" in wide
    store.write_metrics_json(done, str(tmp_path / "json"))
    text = "".join(open(os.path.join(tmp_path / "json", f)).read() for f in os.listdir(tmp_path / "json")
                   if f.endswith(".json"))
    assert json.loads(text.splitlines()[0])["task"] == "self"


def test_task_from_config(tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"name": "X", "data": {"query": {"path": "q"}}, "k_values": [1, 3], "main_metric": "mrr_at_3"}))
    t = RetrievalTask.from_config(str(p))
    assert t.depth == 3 and t.main_key() == ("mrr", 3)


def test_lifecycle_by_subset(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = docs.select(F.col("lang").alias("subset"), F.col("doc_id").cast("string").alias("id"),
                         F.col("text").alias("data"))
    queries = corpus.where("length(data) < 3000")
    qrels = queries.select("subset", F.col("id").alias("qid"), F.col("id").alias("did"), F.lit(1).alias("rel"))
    task = RetrievalTask(name="self", k_values=(1, 3))
    m = evaluate(spark, task, "hashed", lambda: HashedBagOfWords(16), queries, corpus, qrels, str(tmp_path / "o"),
                 by_subset=True)
    vals = {(r.subset, r.metric, r.k): r.value for r in m.collect()}
    langs = {r.subset for r in queries.select("subset").distinct().collect()}
    assert {s for s, _, _ in vals} == langs
    assert all(vals[(s, "recall", 3)] > 0.5 for s in langs)
    run = store.load_run(spark, str(tmp_path / "o" / "runs"), "hashed", "self")
    # every hit stays inside its own subset
    lang = corpus.select("subset", F.col("id").alias("did"))
    assert run.join(lang, ["subset", "did"], "left_anti").count() == 0


def test_lifecycle_candidates_equal_full_depth_filter(spark, tmp_path):
    from rankwell.operators import metrics as M
    from rankwell.operators.candidates import filter_lenient

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("data"))
    queries = corpus.where("doc_id % 4 = 0")
    qrels = queries.select(F.col("id").alias("qid"), F.col("id").alias("did"), F.lit(1).alias("rel"))
    # lists for half of the queries: their own id plus the next ten ids
    cand = (queries.where("cast(id as int) % 8 = 0")
            .select(F.col("id").alias("qid"), F.explode(F.sequence(F.col("id").cast("int"), F.col("id").cast("int") + 10)
                                                          .cast("array<string>")).alias("did")))
    task = RetrievalTask(name="cand", k_values=(1, 3))
    got = evaluate(spark, task, "h", lambda: HashedBagOfWords(16), queries, corpus, qrels, str(tmp_path / "o"),
                   candidates=cand)
    # reference semantics: full-depth retrieval, then the lenient filter, then metrics at k
    emb = embed(corpus, lambda: HashedBagOfWords(16))
    full = search(emb.join(queries.select("id"), "id").withColumnRenamed("id", "qid"),
                  emb.withColumnRenamed("id", "did"), corpus.count())
    want = M.evaluate(filter_lenient(full.drop("rk"), cand), qrels, (1, 3),
                      run_qids=full.select("qid"))
    a = {(r.metric, r.k): r.value for r in got.collect() if ":" not in r.metric}
    b = {(r.metric, r.k): r.value for r in want.collect()}
    assert a == pytest.approx(b)


def test_sequence_inputs_feed_a_multimodal_embedder(spark, tmp_path):
    a = str(tmp_path / "p.tar")
    make_tar(a, {"i1.png": b"12345", "i2.png": b"xy"})
    members = P.read_members(spark, {"imgs": a})
    rows = spark.createDataFrame([
        ("s1", json.dumps(["look", {"path": "i1.png"}, "here", {"path": "i2.png"}])),
        ("s2", json.dumps(["text only"])),
    ], "id string, data string")
    inputs = P.sequence_inputs(rows, members, {"imgs": a}, default="imgs")
    got = {r.id: (r.seq_text, None if r.image is None else bytes(r.image)) for r in inputs.collect()}
    assert got == {"s1": ("look here ", b"12345"), "s2": ("text only ", None)}

    def factory():  # text length and image size as a 2-d "embedding"
        return lambda x: np.array([[len(t), 0 if b is None else len(b)] for t, b in zip(x["seq_text"], x["image"])])

    vecs = {r.id: list(r.vec) for r in embed(inputs, factory, input_cols=("seq_text", "image"),
                                             sort_col="seq_text").collect()}
    assert vecs == {"s1": [10.0, 5.0], "s2": [10.0, 0.0]}
