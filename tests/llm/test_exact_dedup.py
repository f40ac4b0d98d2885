import hashlib

from pyspark.sql import functions as F

from rankwell.llm import exact_dedup as X
from tests.llm.helpers import docs

ROWS = [(1, "Hello World"), (2, "hello world"), (3, "Hallo"), (4, None), (5, ""), (6, "ÄB"), (7, "äb"), (8, "x" * 200_000), (9, "X" * 200_000), (3, "Hallo"), (None, "hallo")]


def expected(rows):
    norm = [("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        out.append((i, max((j for j in ids if j is not None), default=None), len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_groups_nulls_ties_and_case(spark):
    out = X.deduplicate(docs(spark, ROWS)).cache()
    assert found(out) == expected(ROWS)
    kept = out.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in out.collect()})  # one row of each group, repeated ids too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_weak_digest_is_caught_by_the_byte_check(spark):
    weak = lambda norm: F.unhex(F.lit("00"))
    out = X.deduplicate(docs(spark, ROWS), digest=weak)
    assert found(out) == expected(ROWS)


def test_several_micro_batches_keep_state(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    out = X.deduplicate(docs(spark, rows).repartition(6), files_per_batch=1)
    assert found(out) == expected(rows)


def test_kept_rows_have_the_input_columns(spark):
    df = docs(spark, ROWS).withColumn("digest", F.lit("clash")).withColumn("locator", F.lit(7)).withColumn("kept", F.lit(True))
    kept = X.keep_first_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 3, 5, 6, 7, 9]


def test_empty_table(spark):
    assert X.deduplicate(docs(spark, [])).collect() == []
    assert X.keep_first_rows(docs(spark, [])).collect() == []


def test_more_groups_than_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert found(X.deduplicate(docs(spark, ROWS))) == expected(ROWS)
    assert X.keep_first_rows(docs(spark, ROWS)).count() == len({r[3] for r in expected(ROWS)})


def test_settings_of_the_session_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in X._STATE}
    X.deduplicate(docs(spark, ROWS[:2])).collect()
    assert {k: spark.conf.get(k, None) for k in X._STATE} == before
