import random

import numpy as np
import xxhash

from rankwell.llm import simhash as S
from tests.llm.helpers import by, components, docs


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus():
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "Äa b"), (6, "äa b"), (6, "äa b"), (None, "one two"), (7, "w " * 50_000)]
    for i in range(40):
        words = [f"w{r.randrange(500)}" for _ in range(r.randint(30, 200))]
        for _ in range(r.choice((1, 1, 2, 6))):
            copy = list(words)
            copy[r.randrange(len(copy))] = "edit"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_fingerprint():
    for text in [t for _, t in corpus()][:30] + ["a b c d", "a b c d e", "a\x0bb\x1cc"]:
        assert S.fingerprint((text or "").encode()) == slow_fingerprint(text)


def check(spark, rows, **options):
    got = S.near_duplicates(docs(spark, rows), **options)
    f = np.array([S.fingerprint((t or "").encode()) for _, t in rows], dtype=np.uint64)
    links = [(i, j) for i in range(len(f)) for j in range(i) if int(np.bitwise_count(f[i] ^ f[j])) <= 4]
    root = components(len(f), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    want = [(rows[i][0], format(int(f[i]), "016x"), least.get(root[i])) for i in range(len(f))]
    assert by(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def test_components_against_all_pairs(spark):
    check(spark, corpus())


def test_two_blocks_and_split_anchors(spark):
    check(spark, corpus()[:60], layout=S.TWO_BLOCKS)
    check(spark, corpus()[:60], homes_per_task=1)


def test_every_pair_within_the_distance_meets():
    r = np.random.default_rng(2)
    for layout in (S.THREE_BLOCKS, S.TWO_BLOCKS):
        for _ in range(40):
            a = int(r.integers(0, 2**63))
            b = a
            for bit in r.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            at = {}
            for x in (a, b):
                anchor, _, home = S.replicate(np.array([x], dtype=np.uint64).view(np.int64), layout)
                at[x] = (set(anchor.tolist()), set(anchor[home].tolist()))
            assert at[a][1] & at[b][0] and at[b][1] & at[a][0]


def test_dense_anchor_gives_a_forest(spark):
    # Thousands of near fingerprints at one anchor: edges stay linear in the rows.
    r = np.random.default_rng(3)
    fps = np.unique(np.array([sum(1 << int(b) for b in r.choice(60, 2, replace=False)) for _ in range(3000)], dtype=np.int64))
    rows = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    edges = S.near_links(rows, homes_per_task=300)
    assert edges.count() < 60 * len(fps)
    from rankwell.llm.components import components as parts

    assert {r.component for r in parts(edges).collect()} == {int(fps.min())}


def test_representatives_keep_the_columns(spark):
    df = docs(spark, corpus()).selectExpr("*", "1 as fp", "2 as component", "3 as least")
    kept = S.keep_representatives(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.component_id for r in S.near_duplicates(docs(spark, corpus())).collect()}


def test_empty_table(spark):
    assert S.near_duplicates(docs(spark, [])).collect() == []
    assert S.keep_representatives(docs(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    from rankwell.llm.components import components as parts

    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 700)] + [(800, 800), (900, 901), (901, 900), (901, 900)]
    got = {r.node: r.component for r in parts(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {i: 500 for i in range(500, 700)} | {900: 900, 901: 900}
    assert got == want
    assert parts(spark.createDataFrame([], "a long, b long")).collect() == []
