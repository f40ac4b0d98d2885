"""The conversation trie against a plain construction, and the contraction on its own."""

import hashlib
import random
import zlib

import pytest

from rankwell.llm import common, conversation_trie as X

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the trie as sorted tuples, built in plain Python."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for k, inside in nodes.items():
        below = [y for y in nodes if y[: len(k)] == k]
        kids = [y for y in below if len(y) == len(k) + 1]
        leaves = [y for y in below if not any(z[: len(y)] == y and len(z) == len(y) + 1 for z in below)]
        saved = sum((len(nodes[y]) - 1) * (len(y[-1][1]) if y else 0) for y in below)
        ends = ",".join(map(str, sorted(c for c in inside if len(built[c]) == len(k))))
        out.append((min(inside), len(k), min(nodes[k[:-1]]) if k else None, len(inside), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    got = X.prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as a", "'x' as kids"))  # clashing names
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, ids, length, words=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), "w" * r.randint(1, words)) for c in ids for t in range(r.randint(1, length))]


def test_random_conversations(spark):
    rows = conversations(1, [*range(0, 130, 3), 200, 201, 377, 405], 7)
    random.Random(2).shuffle(rows)
    assert trie(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(None, 1, "a", "b"), (7, None, None, None), (7, 2, "u", None), (7, 2, "u", None), (7, None, "u", "é😀"), (100, 0, "u", ""), (-205, 3, "u", "neg"), (-200, 1, "u", "neg base"),
            (101, 0, "u", "x"), (102, 0, "u", "x"), (105, 5, "b", "a:b"), (105, 4, "b:", "a")]
    assert trie(spark, rows) == brute(rows)


def test_empty_table_and_no_ids(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []


def test_long_conversation_over_many_tasks_and_a_hot_family(spark):
    """A third of all turns in one conversation, in chains over partition borders; equal conversations end at one node."""
    rows = [(400, t, "u", "ab"[t % 2] * (1 + t % 3)) for t in range(90)]
    rows += [(c, t, "u", "same") for c in range(1000, 1040) for t in range(4)] + conversations(5, range(401, 430), 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
        first = X.first_turns(turns)
        assert first.where("conv_id = 400").count() == 90
        assert [r["i"] for r in first.where("conv_id = 400").orderBy("i").collect()] == list(range(90))
        got = sorted((tuple(r) for r in X.prefix_trie(turns).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_hashes_do_not_depend_on_the_cut_into_partitions():
    """Parts of a long conversation are put together as if one task had read all."""
    p, u = X.PRIMES[0], X.BASES[0]
    q, v = X.PRIMES[1], X.BASES[1]
    xs = list(range(1, 40))

    def part(xs):
        a = b = 0
        for x in xs:
            a, b = (a * u + x) % p, (b * v + x) % q
        return a, b

    tails = [{"pid": i, "conv_id": 9, "i": len(c) - 1, "a": part(c)[0], "b": part(c)[1]} for i, c in enumerate([xs[:10], xs[10:25], xs[25:]])]
    carry = X._carried(tails)
    assert 0 not in carry and carry[1] == (9, 10, *part(xs[:10])) and carry[2] == (9, 25, *part(xs[:25]))


@pytest.mark.parametrize("shape", ["random", "chain", "star", "broom"])
def test_contraction_gives_subtree_sums(spark, shape, monkeypatch):
    r = random.Random(shape)
    n = 60
    parent = {"random": [None] + [r.randrange(i) for i in range(1, n)], "chain": [None, *range(n - 1)], "star": [None] + [0] * (n - 1),
              "broom": [None, *range(n // 2 - 1)] + [n // 2 - 1] * (n - n // 2)}[shape]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    value = [r.randint(0, 9) for _ in range(n)]
    kids = [sum(p == i for p in parent) for i in range(n)]
    want = list(value)
    for i in sorted(range(n), key=depth.__getitem__, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    rounds = []
    staged = X.staged
    monkeypatch.setattr(X, "staged", lambda df, tag: rounds.append(tag) or staged(df, tag))
    rows = [(i, i, parent[i], parent[i], depth[i], kids[i], value[i]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "a long, b long, pa long, pb long, depth long, kids long, v long")
    got = {x["a"]: x["v"] for x in X.contract(nodes, ["v"]).collect()}
    assert got == dict(enumerate(want))
    assert rounds.count("trie-met") <= 9  # log rounds, also for a chain of 60


def test_ids_under_a_digest_come_in_chunks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 2, i) for i in range(500)] + [(1, 3, 7)], "a long, b long, conv_id long").repartition(5)
    got = {(r["a"], r["b"]): r["ends_sha256"] for r in X.end_digests(rows).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
    out = list(X._digests(X._chunks(iter(spark.range(1, 1).toArrow().to_batches()))))
    assert out == []


def test_lookup_join_splits_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 9)] + [(99, 1)], "k long, x long")
    table = spark.createDataFrame([(1, "hot", 50)] + [(k, f"v{k}", 1) for k in range(2, 9)], "k long, v string, n long")
    got = common.lookup_join(rows, table, ["k"], "n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()
    assert sorted((r["k"], r["v"], r["x"]) for r in got.collect()) == sorted([(1, "hot", i) for i in range(50)] + [(k, f"v{k}", 0) for k in range(2, 9)])
