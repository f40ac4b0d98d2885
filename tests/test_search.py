"""Blocked search vs brute force; merge, grouping, parts, candidates."""

import numpy as np
import pandas as pd
import pytest

from rankwell.operators.candidates import candidate_pairs, filter_lenient, filter_strict
from rankwell.operators.rank import skip_first, top_k
from rankwell.operators.score import partial_topk, search


def brute(q, c, k, norm=True, excl=False, group=None):
    out = []
    qm = np.array(list(q.vec), dtype=float)
    cm = np.array(list(c.vec), dtype=float)
    if norm:
        with np.errstate(invalid="ignore"):
            qm = qm / np.maximum(np.sqrt((qm * qm).sum(1, keepdims=True)), 1e-12)
            cm = cm / np.maximum(np.sqrt((cm * cm).sum(1, keepdims=True)), 1e-12)
    s = qm @ cm.T
    s[np.isnan(s)] = -1
    s = np.round(s, 9)
    for i, qid in enumerate(q.qid):
        cand = [(s[i, j], did) for j, did in enumerate(c.did)
                if not (excl and did == qid) and (group is None or q[group].iloc[i] == c[group].iloc[j])]
        cand.sort(reverse=True)
        out += [(qid, d, float(sc), r + 1) for r, (sc, d) in enumerate(cand[:k])]
    return sorted(out)


def frame(spark, pdf, cols):
    return spark.createDataFrame(pdf[cols])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n, dim = 60, 8
    vecs = rng.integers(-2, 3, size=(n, dim)).astype(float)  # small integers: many exact ties
    vecs[3] = 0.0
    vecs[5, 0] = np.nan
    vecs[11] = vecs[10]
    ids = [f"d{i}" for i in range(n)]
    grp = [f"g{i % 4}" for i in range(n)]
    return pd.DataFrame({"id": ids, "vec": list(vecs), "grp": grp})


@pytest.mark.parametrize("k,norm,excl", [(1, True, False), (5, True, True), (7, False, False), (80, True, True)])
def test_search_equals_brute_force(spark, data, k, norm, excl):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    got = search(frame(spark, q, ["qid", "vec"]), frame(spark, c, ["did", "vec"]), k, do_norm=norm,
                 exclude_identical=excl)
    rows = sorted((r.qid, r.did, round(r.score, 9), r.rk) for r in got.collect())
    assert rows == brute(q, c, k, norm, excl)


def test_search_without_broadcast_and_many_blocks(spark, data):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    got = search(frame(spark, q, ["qid", "vec"]), frame(spark, c, ["did", "vec"]).repartition(5), 4,
                 query_block_bytes=300, broadcast_bytes=0)
    assert sorted((r.qid, r.did, round(r.score, 9), r.rk) for r in got.collect()) == brute(q, c, 4)


def test_grouped_search(spark, data):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    got = search(frame(spark, q, ["qid", "vec", "grp"]), frame(spark, c, ["did", "vec", "grp"]), 3,
                 group_cols=["grp"], chunk_rows=4, query_block_bytes=200)
    rows = sorted((r.qid, r.did, round(r.score, 9), r.rk) for r in got.collect())
    assert rows == brute(q, c, 3, group="grp")


def test_corpus_part_and_merge(spark, data):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    parts = search(frame(spark, q, ["qid", "vec"]), frame(spark, c, ["did", "vec", "grp"]), 3, corpus_part="grp")
    per = sorted((r.grp, r.qid, r.did) for r in parts.collect())
    for g in ("g0", "g2"):
        sub = c[c.grp == g]
        want = brute(q, sub, 3)
        assert sorted((qid, did) for gg, qid, did in per if gg == g) == sorted((a, b) for a, b, _, _ in want)
    merged = top_k(parts.drop("rk"), 3)
    assert sorted((r.qid, r.did, round(r.score, 9), r.rk) for r in merged.collect()) == brute(q, c, 3)


def test_partial_topk_ties():
    s = np.array([[1.0, 1.0, 1.0, 0.5]])
    r, c = partial_topk(s, np.array(["a", "c", "b", "z"], dtype=object), 2)
    assert sorted(c.tolist()) == [1, 2]  # ids c and b beat a
    big = np.array([[3e12, 3e12, 5.0, 3e12]])  # key would overflow int64: row-wise sort path
    r, c = partial_topk(big, np.array(["a", "c", "b", "z"], dtype=object), 2,
                        valid=np.array([[True, True, True, False]]))
    assert sorted(c.tolist()) == [0, 1]


def test_candidates_post_equals_pre_at_full_depth(spark, data):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    qdf, cdf = frame(spark, q, ["qid", "vec"]), frame(spark, c, ["did", "vec"])
    cand = spark.createDataFrame([(f"d{i}", f"d{j}") for i in range(0, 60, 3) for j in range(i, min(60, i + 9))],
                                 "qid string, did string")
    full = search(qdf.join(cand.select("qid").distinct(), "qid"), cdf, 60)
    post = top_k(filter_strict(full, cand).drop("rk"), 5)
    pre = top_k(candidate_pairs(cand, qdf, cdf), 5)
    a = sorted((r.qid, r.did, r.rk) for r in post.collect())
    b = sorted((r.qid, r.did, r.rk) for r in pre.collect())
    assert a == b


def test_strict_filter_fails_on_missing_qid(spark):
    run = spark.createDataFrame([("q1", "a", 1.0), ("q2", "b", 1.0)], "qid string, did string, score double")
    cand = spark.createDataFrame([("q1", "a")], "qid string, did string")
    with pytest.raises(Exception):
        filter_strict(run, cand).collect()


def test_lenient_filter_semantics(spark):
    run = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 0.5), ("q2", "b", 1.0), ("q3", "c", 1.0)],
                                "qid string, did string, score double")
    cand = spark.createDataFrame([("q1", "b"), ("q3", None)], "qid string, did string")
    got = sorted((r.qid, r.did) for r in filter_lenient(run, cand).collect())
    assert got == [("q1", "b"), ("q2", "b")]  # q2 has no list: kept; q3's list is empty: dropped
    empty = spark.createDataFrame([], "qid string, did string")
    assert filter_lenient(run, empty).count() == 4


def test_skip_first(spark):
    run = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 0.1)], "qid string, did string, score double")
    got = sorted((r.did, r.rk) for r in skip_first(run).collect())
    assert got == [("b", 1), ("c", 2)]


def test_repartition_invariance(spark, data):
    q = data.rename(columns={"id": "qid"})
    c = data.rename(columns={"id": "did"})
    a = search(frame(spark, q, ["qid", "vec"]), frame(spark, c, ["did", "vec"]).repartition(1), 5)
    b = search(frame(spark, q, ["qid", "vec"]).repartition(7), frame(spark, c, ["did", "vec"]).repartition(9), 5)
    assert sorted(a.collect()) == sorted(b.collect())


def test_lenient_search_has_no_depth_before_the_filter(spark):
    """A listed turn far below rank 1000 of its conversation is found; queries without a list keep their best."""
    from rankwell.plans.roundtrips import lenient_search

    c = spark.createDataFrame([(f"d{i:04}", "c", [float(1500 - i), 1.0]) for i in range(1500)] + [("x", "other", [9999.0, 1.0])], "did string, conv_id string, vec array<double>")
    q = spark.createDataFrame([("a", "c", [1.0, 0.0]), ("b", "c", [1.0, 0.0]), ("e", "c", [1.0, 0.0])], "qid string, conv_id string, vec array<double>")
    cand = spark.createDataFrame([("a", "d1400"), ("a", "x"), ("e", None)], "qid string, did string")
    got = sorted((r.qid, r.did, r.score) for r in lenient_search(q, c, 2, cand).collect())
    assert got == [("a", "d1400", 100.0), ("b", "d0000", 1500.0), ("b", "d0001", 1499.0)]
