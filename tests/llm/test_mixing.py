from collections import defaultdict

from pyspark.sql import functions as F

from rankwell.llm import mixing as M
from tests.llm.helpers import docs


def targets(sizes):
    """By the contract's words: reshare the excess over 3 times the size by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if w else {}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def rows():
    out = []
    for s, (n, words) in {"a": (40, 3), "b": (3, 2), "c": (5, 50), "é": (2, 1), "": (1, 400), None: (4, 9)}.items():
        out += [(len(out) + i, "w " * (words + i % 3), None, s) for i in range(n)]
    return out + [(900, None, None, "a"), (901, "", None, None), (902, " \t\n", None, "c"), (0, "w w w", None, "a"), (None, "one two", None, "b"), (None, "one two", None, "b")]


def test_targets_budgets_and_epochs(spark):
    data = rows()
    out = M.mix(M.sized_documents(docs(spark, data)), rows_per_bucket=4).collect()
    assert len(out) == len(data)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert taken[s] == int(target[s] + 0.5)
    assert all(r.source_size == sizes[r.source] for r in out)


def test_at_most_one_document_of_a_source_is_cut(spark):
    cut = defaultdict(set)
    for r in M.mix(M.sized_documents(docs(spark, rows())), rows_per_bucket=4).collect():
        if r.size:
            cut[r.source].add(r.taken % r.size != 0 and r.doc_id)
    assert all(len(c - {False}) <= 1 for c in cut.values())


def test_buckets_do_not_change_the_result(spark):
    sized = M.sized_documents(docs(spark, rows()))
    a, b = (sorted(map(str, M.mix(sized, rows_per_bucket=n).collect())) for n in (3, 100_000))
    assert a == b


def test_taken_documents(spark):
    df = docs(spark, rows()).withColumn("taken", F.lit("clash")).withColumn("size", F.lit(-1))
    out = M.take_documents(df, rows_per_bucket=5)
    assert out.columns == df.columns
    mixed = M.mix(M.sized_documents(df), rows_per_bucket=5)
    want = {r.source: r.w for r in mixed.groupBy("source").agg(F.sum("taken").alias("w")).collect() if r.w}
    got = {r.source: r.w for r in out.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("w")).collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_empty_table_and_no_words(spark):
    assert M.mix(M.sized_documents(docs(spark, []))).collect() == []
    out = M.mix(M.sized_documents(docs(spark, [(1, None, None, "a"), (2, "", None, None)]))).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
    assert M.take_documents(docs(spark, [(1, "", None, "a")])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = M.op6_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
