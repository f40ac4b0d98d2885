"""What the search copies, and that its float32 bound loses no hit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import score as S


def test_a_chunk_is_sent_once_per_team_not_once_per_block(spark, tmp_path):
    r = np.random.default_rng(5)
    spark.createDataFrame([(f"x{i}", r.random(4).tolist()) for i in range(1500)], "id string, vec array<double>").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    q, c = df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did")
    pairs = S._pairs_global(q, c, 1500, 4, 10, 300, False, 0)  # 500 blocks of three queries
    cores = spark.sparkContext.defaultParallelism
    assert pairs.where(F.size("c_items") > 0).agg(F.sum(F.size("c_items"))).first()[0] <= 1500 * 2 * cores
    teams = pairs.groupBy("blk").agg(F.max(F.size("q_items")).alias("n"))
    assert teams.agg(F.sum("n")).first()[0] == 1500
    got = S.search(q, c, 10, exclude_identical=True, query_block_bytes=300, broadcast_bytes=0).select("qid", "did", "rk")
    want = S.search(q, c, 10, exclude_identical=True).select("qid", "did", "rk")
    assert got.count() == 15000 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("norm", [True, False])
def test_bound_loses_no_hit(norm):
    """Ties, zero vectors, NaN, infinite and very large or small vectors, over many chunks, against all scores."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    vecs = r.integers(-2, 3, size=(3000, 8)).astype(float)
    vecs[::7] *= 1e-3
    vecs[::11] *= 1e120
    vecs[::13] *= 1e-120
    vecs[5], vecs[6, 0], vecs[8, 1] = 0.0, np.nan, np.inf
    ids = np.array([f"d{i}" for i in range(len(vecs))], dtype=object)

    def items(at):
        whole = pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(list(vecs[at]))], names=["id", "vec"])
        return pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), whole)

    few = np.arange(0, 60)
    none = pa.nulls(1, items(few).type)
    rows = [(items(few[:25]), none), (items(few[25:]), none)] + [(none, items(at)) for at in np.array_split(np.arange(3000), 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), q, c], names=["blk", "q_items", "c_items"]) for q, c in rows]
    got: dict = {}
    for b in S._scorer(7, norm, True, [], False)(iter(batches)):
        for qid, did, score in zip(*(x.to_pylist() for x in b.columns)):
            got.setdefault(qid, []).append((float(S.sort_keys(np.array([score]))[0]), did))
    with np.errstate(all="ignore"):
        m = S._normalise(vecs) if norm else vecs
        keys = S.sort_keys(S._settled(np.array([np.einsum("ij,ij->i", np.broadcast_to(m[i], m.shape), m) for i in few]), norm))
    for i in few:
        want = sorted(((keys[i, j], ids[j]) for j in range(3000) if j != i), reverse=True)[:7]
        assert sorted(got[ids[i]], reverse=True) == want


def test_bound_step_holds_small_matrices_only():
    """Products of a slice are compared in small pieces: the same pairs in the same order, a fraction of the memory."""
    import tracemalloc

    r = np.random.default_rng(7)
    for n, m in ((400, 10000), (1500, 1001)):
        q = S._Queries(np.array([f"q{i}" for i in range(n)], dtype=object), r.normal(size=(n, 16)), True)
        docs = S._Documents(None, np.arange(m), np.array([f"d{i}" for i in range(m)], dtype=object), S._normalise(r.normal(size=(m, 16))))
        docs.odd[7] = True
        rows, low = np.arange(1, n, 2), r.uniform(0.6, 0.8, n)
        tracemalloc.start()
        got = S._close_pairs(q, rows, docs, slice(5, m), low)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        near = q.vecs[rows] @ docs.vecs[5:].T >= low[rows][:, None]
        near[:, 2] = True
        have = set(zip(got[0].tolist(), got[1].tolist()))
        want = {(i, j + 5) for i, j in zip(*(x.tolist() for x in np.nonzero(near)))}
        assert want <= have and len(have) <= 1.01 * len(want) + 5 and (np.diff(got[0]) >= 0).all()
        assert peak < max(4 << 20, 2 * near.size)  # float32 products of all pairs take four bytes each


@pytest.mark.parametrize("shape", [(3, 8), (5, 7), (0, 8), (64, 24)])
def test_places_of_true_cells(shape):
    mask = np.random.default_rng(8).random(shape) < 0.2
    assert np.array_equal(S._places(mask), np.flatnonzero(mask))


def test_deep_lists_are_merged_in_small_matrices_and_ids_without_hits_are_dropped(monkeypatch):
    """new keys of many queries meet deep lists a few queries at a time; of the documents met, only ids of hits are held."""
    import tracemalloc

    r = np.random.default_rng(8)
    n, k = 400, 1000
    mine = S._Running([], S._Queries(np.array([f"q{i}" for i in range(n)], dtype=object), r.normal(size=(n, 4)), True), k)
    mine.start(None)
    rows, scores = np.arange(n), []
    for m in (3000, 4000, 2000):
        key = r.normal(size=(n, m))
        scores.append(key)
        at, d = np.divmod(np.arange(n * m), m)
        tracemalloc.start()
        mine._merge(mine.floor[None].copy(), mine.low[None].copy(), rows, at, key.reshape(-1))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * n * k + 4 * 8 * at.size + 4 * 8 * S.MERGE_CELLS  # lists, numbers and one small matrix
        mine.offer(None, rows, at, d, key.reshape(-1), key.reshape(-1))
        mine.chunk_done(np.array([f"d{mine.n_dids + j}" for j in range(m)], dtype=object))
    want = -np.partition(-np.concatenate(scores, axis=1), k - 1, axis=1)[:, :k]
    assert (np.sort(mine.floor[None], axis=1) == np.sort(want, axis=1)).all()
    mine.cut(final=True)
    part, q, d, key, score = mine.rows[0]
    assert len(q) == n * k and (np.bincount(q) == k).all() and (key == score).all()
    whole, ids = np.concatenate(scores, axis=1), np.concatenate(mine.dids)
    assert (whole[q, [int(x[1:]) for x in ids[d]]] == key).all()

    import pyarrow as pa

    def items(ids, vecs):
        whole = pa.StructArray.from_arrays([pa.array(ids), pa.array(list(vecs))], names=["id", "vec"])
        return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), whole)

    monkeypatch.setattr(S, "MAX_IDS", 500)
    held, cut = [], S._Running.cut

    def counted(self, final=False):
        held.append(self.n_dids)
        cut(self, final)

    monkeypatch.setattr(S._Running, "cut", counted)
    vecs = r.normal(size=(10000, 4))
    q = items([f"q{i}" for i in range(5)], vecs[:5])
    none = pa.nulls(1, q.type)
    rows = [(q, none)] + [(none, items([f"d{i}" for i in at], vecs[at])) for at in np.array_split(np.arange(10000), 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), a, b], names=["blk", "q_items", "c_items"]) for a, b in rows]
    got = [x for b in S._scorer(3, True, False, [], False)(iter(batches)) for x in b.column("did").to_pylist()]
    assert len(got) == 15 and {f"d{i}" for i in range(5)} <= set(got)
    assert max(held) <= 700


@pytest.mark.parametrize("streamed", [True, False])
def test_queries_whose_hits_were_emitted_early_meet_the_later_chunks(streamed, monkeypatch):
    """when the buffer stays full, its hits are emitted and the search goes on; no later document is lost."""
    import pyarrow as pa

    n, k = 60, 7
    monkeypatch.setattr(S, "MAX_BUFFER", 500)  # n * k hits are more than its share
    r = np.random.default_rng(9)
    vecs = r.normal(size=(4000, 8))
    ids = np.array([f"d{i}" for i in range(len(vecs))], dtype=object)

    def items(at):
        whole = pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(list(vecs[at]))], names=["id", "vec"])
        return pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), whole)

    q, chunks = items(np.arange(n)), [items(at) for at in np.array_split(np.arange(4000), 8)]
    none = pa.nulls(1, q.type)
    rows = [(q, none)] + [(none, c) for c in chunks] if streamed else [(q, c) for c in chunks]
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), a, b], names=["blk", "q_items", "c_items"]) for a, b in rows]
    got: dict = {}
    for b in S._scorer(k, True, True, [], False)(iter(batches)):
        for qid, did, score in zip(*(x.to_pylist() for x in b.columns)):
            got.setdefault(qid, []).append((float(S.sort_keys(np.array([score]))[0]), did))
    m = S._normalise(vecs)
    for i in range(n):
        keys = S.sort_keys(S._settled(np.einsum("ij,ij->i", np.broadcast_to(m[i], m.shape), m), True))
        want = sorted(((keys[j], ids[j]) for j in range(4000) if j != i), reverse=True)[:k]
        assert sorted(got[ids[i]], reverse=True)[:k] == want


def test_a_large_arrow_batch_is_taken_in_small_pieces(spark):
    """counting, embedding and packing hold a few MB at once, not a batch of 64 MB and its copies."""
    import tracemalloc

    import pyarrow as pa

    from rankwell.operators import blocks as B
    from rankwell.operators import embed as E

    r = np.random.default_rng(10)
    buckets = [r.integers(0, 16, size=n).astype(np.int32) for n in r.integers(0, 20000, size=600)]
    buckets[3], buckets[4], buckets[-1] = None, np.zeros(0, np.int32), np.zeros(3_000_000, np.int32)
    want = np.array([np.bincount(b if b is not None else [], minlength=16) for b in buckets])
    tracemalloc.start()
    got = E._counts(buckets, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 20 * 3_000_000 + 8 * 4 * E.COUNT_TOKENS  # the longest row, and a share
    assert E._counts([], 4).shape == (0, 4) and (E._counts([None], 4) == 0).all()

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(40)]), pa.array(["x" * (1 << 20)] * 40)], names=["id", "data"])
    parts = list(E._slices(iter([batch, batch.slice(0, 0)])))
    assert [x for p in parts for x in p["id"]] == [str(i) for i in range(40)] and max(len(p) for p in parts) <= 8
    docs = spark.range(40).coalesce(1).selectExpr("cast(id as string) AS did", "repeat('x', 1048576) AS dtext")
    chunks = B.pack_partitions(docs, ["did", "dtext"]).selectExpr("cb", "transform(items, i -> i.did) AS dids").collect()
    assert sorted(int(d) for c in chunks for d in c["dids"]) == list(range(40)) and len({c["cb"] for c in chunks}) == len(chunks)
    assert max(len(c["dids"]) for c in chunks) <= 8


def test_few_large_groups_are_searched_by_teams(spark, monkeypatch):
    """Too many queries to broadcast, in few groups: a document goes once to each team of its group, a query to each cell of its team."""
    r = np.random.default_rng(8)
    rows = [(f"x{i}", None if i % 50 == 0 else "hot" if i % 5 else f"g{i % 3}", i % 2, r.integers(0, 4, 6).astype(float).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, grp string, half int, vec array<double>").repartition(3)
    q, c = df.where("id < 'x7'").withColumnRenamed("id", "qid"), df.where("grp is null or grp <> 'g1'").withColumnRenamed("id", "did")
    want = {k: S.search(q, c, 7, group_cols=k, exclude_identical=True).select(*k, "qid", "did", "score", "rk").collect() for k in (("grp",), ("grp", "half"))}
    parts = S.search(q, c, 2, group_cols=["grp"], corpus_part="half").collect()
    monkeypatch.setattr(S, "conf_int", lambda spark, key, default: 0)  # nothing may be broadcast
    monkeypatch.setattr(S, "TEAM_QUERIES", 100)
    pairs = S._pairs_streamed_groups(q, c, ["grp"], 6, 7, False)
    sent = pairs.selectExpr("grp", "blk", "size(c_items) as d", "size(q_items) as n").groupBy("grp").sum("d", "n").collect()
    hot_q, hot_c = (x.where("grp = 'hot'").count() for x in (q, c))
    hot = next(x for x in sent if x["grp"] == "hot")
    teams, salts = S._teams(q, hot_q, 1)
    assert teams > 1 and hot["sum(d)"] == hot_c * teams and hot["sum(n)"] == hot_q * salts
    assert all(x["grp"] is not None for x in sent) and pairs.groupBy("blk").agg(F.count_distinct("grp").alias("n")).where("n > 1").isEmpty()
    for k, rows in want.items():
        got = S.search(q, c, 7, group_cols=k, exclude_identical=True).select(*k, "qid", "did", "score", "rk").collect()
        assert len(got) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, rows))
    assert sorted(map(str, S.search(q, c, 2, group_cols=["grp"], corpus_part="half").collect())) == sorted(map(str, parts))
    assert S._pairs_streamed_groups(q.withColumn("grp", F.col("qid")), c, ["grp"], 6, 7, False) is None  # many groups


def test_chunks_of_a_group_are_bounded(spark, monkeypatch):
    from rankwell.operators import blocks as B

    df = spark.range(0, 3000, 1, 1).selectExpr("cast(id as string) as did", "cast(id % 2 as string) as grp", "array_repeat(cast(id as double), 100) as vec")
    batch = df.toArrow().to_batches()[0]
    monkeypatch.setattr(B, "CHUNK_BYTES", 200_000)
    slices = list(B._slices(iter([batch])))
    assert len(slices) > 10 and sum(x.num_rows for x in slices) == batch.num_rows and slices[0].nbytes < 250_000
    packed = B.pack_groups(df, ["grp"], ["did", "vec"]).selectExpr("grp", "size(items) as n").groupBy("grp").sum("n").collect()
    assert sorted((x["grp"], x["sum(n)"]) for x in packed) == [("0", 1500), ("1", 1500)]
