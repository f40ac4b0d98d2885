import numpy as np
import pytest

from rankwell.llm import near_vectors as V
from tests.llm.helpers import by, components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v, x) else None for _, v, x in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    root = components(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], 10**9), 10**9 if r[0] is None else r[0])
    degree = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows)) if links else [0] * len(rows)
    return sorted((r[0], int(degree[i]), least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(rows))


def clustered(n, dim=24, seed=1, dense=0):
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre, label = r.normal(size=dim), int(r.integers(0, 3))
        for _ in range(r.choice([1, 1, 1, 2, 5, 14])):
            rows.append((len(rows), (centre + r.normal(size=dim) * 0.05).astype(np.float32).tolist(), label))
    centre = r.normal(size=dim)
    for _ in range(dense):
        rows.append((len(rows), (centre + r.normal(size=dim) * 0.04).astype(np.float32).tolist(), 1))
    return rows


def found(df):
    return by(df, "vec_id", "n_links", "component_id", "kept")


@pytest.mark.parametrize("dense", [0, 150])
def test_against_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rows = clustered(400, dense=dense)
    assert found(V.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edge_rows(spark):
    a, b = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [0.0, -0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1),
            (10, [float("inf"), 1.0, 1.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, b, 1), (12, b, 1), (13, [1.0, 2.0], 1), (14, [], 1), (15, [1e-30, 2e-30, 3e-30], 1), (16, [1e30, 2e30, 3e30], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rid", "1 as n", "2 as vec")
    assert found(V.near_duplicates(df)) == brute(rows)


def test_empty_table(spark):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_id(spark):
    out = V.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], SCHEMA)).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out) == sorted(map(str, [(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)]))


def test_audit_counts_links(spark):
    rows = clustered(200)
    reps = spark.createDataFrame([(i, str(x), np.array(v, np.float32).tobytes()) for i, v, x in rows], "rid long, label string, vec binary")
    degree = {i: n for i, n, _, _ in brute(rows)}
    links = spark.createDataFrame([(i, n) for i, n in degree.items()], "rid long, near long")
    recall, true = V.audit(reps, links, 0.98, n_queries=len(rows))
    assert recall == 1.0 and true == sum(degree.values())
    recall, _ = V.audit(reps, links.where("near > 1"), 0.98, n_queries=len(rows))
    assert recall < 1.0


def test_refinement_mends_a_poor_graph(spark):
    rows = clustered(300, seed=4)
    reps = spark.createDataFrame([(i, str(x), np.array(v, np.float32).tobytes()) for i, v, x in rows], "rid long, label string, vec binary")
    # Random neighbours of the same label: local joins alone have to find the near ones.
    r = np.random.default_rng(0)
    edges = []
    for i, _, x in rows:
        same = [j for j, _, y in rows if y == x and j != i]
        edges += [(i, int(j), -1.0) for j in r.choice(same, 10, replace=False)]
    graph = spark.createDataFrame(edges, "u long, v long, c double")
    unit = np.array([v for _, v, _ in rows]) / np.linalg.norm(np.array([v for _, v, _ in rows]), axis=1)[:, None]
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98}
    for n in range(4):
        graph = spark.createDataFrame(V.refine(graph, reps, 14, n).collect(), "u long, v long, c double")
    got = {(e.u, e.v) for e in graph.collect() if e.c >= 0.98}
    assert len(want & got) >= 0.95 * len(want) and not got - want


def test_one_tight_group_over_several_blocks(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=64)
    rows = [(i, (centre + r.normal(size=64) * 0.001).astype(np.float32).tolist(), 1) for i in range(1500)]
    assert found(V.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == [(i, 1499, 0, i == 0) for i in range(1500)]


def test_lists_full_of_closer_ones_keep_the_group_whole(spark):
    r = np.random.default_rng(4)
    centre, rows = r.normal(size=24), []
    for _ in range(20):
        inner = centre + r.normal(size=24) * 0.03
        rows += [(len(rows) + i, (inner + r.normal(size=24) * 0.0005).astype(np.float32).tolist(), 1) for i in range(20)]
    assert found(V.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_tables_grow_with_the_bits():
    for bits in range(25):
        together = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - together) ** V.tables_for(bits, 0.98, 0.995) >= 0.995
    assert V.tables_for(0, 0.98, 0.995) == V.TABLES


def test_audit_goes_on_until_it_meets_links(monkeypatch):
    asked = []
    monkeypatch.setattr(V, "audit", lambda reps, links, threshold, n: (asked.append(n) or 1.0, n // 256))
    assert V.audit_enough(None, None, 0.98, 10**6) == (1.0, 64) and asked == [256, 2048, 16384]


def test_low_recall_is_not_returned(spark, monkeypatch):
    monkeypatch.setattr(V, "MORE", 1, raising=False)
    monkeypatch.setattr(V, "audit", lambda *a: (0.5, 500))
    with pytest.raises(RuntimeError, match="recall 0.5"):
        V.near_duplicates(spark.createDataFrame(clustered(40), SCHEMA))
