"""Physical-plan shape: the plans the operators are designed to produce."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from rankwell.plans.catalog import REGISTRY
from rankwell.operators.score import _pairs_grouped, search
from rankwell.sources.families import vec_family

SF01 = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_plan(spark):
    fam = vec_family(spark, SF01)
    p = plan(search(fam.queries, fam.corpus, 10))
    assert "BroadcastHashJoin" in p and "MapInArrow" in p
    assert p.count("WindowGroupLimit") >= 2  # partial before the shuffle, final after
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_search_without_broadcast_uses_salted_shuffle_join(spark):
    fam = vec_family(spark, SF01)
    p = plan(search(fam.queries, fam.corpus, 10, broadcast_bytes=0, query_block_bytes=4096))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "SortMergeJoin" in p or "ShuffledHashJoin" in p


def test_scans_are_pruned(spark):
    df = E.queries()["flagship_eval"](spark, SF01)
    df.collect()
    p = plan(df)
    schemas = [line.split("ReadSchema: ")[1] for line in p.splitlines()
               if "FileScan parquet" in line and "embeddings" in line]
    assert schemas
    assert all("embedding:array<float>" not in s for s in schemas if "label" in s)  # qrels side: no vectors
    assert all("label" not in s for s in schemas if "embedding" in s)  # vector side: no labels


def test_every_registered_query_is_free_of_nested_loop_joins(spark):
    skip = {"stream_topk", "sweep_report"}
    for name, q in E.queries().items():
        if name in skip or name not in REGISTRY:
            continue
        p = plan(q(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_hot_group_is_spread(spark):
    """One group holding a third of the corpus is scored in many tasks."""
    n, hot = 900, 300
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", "hot" if i < hot else f"g{i % 60}", rng.random(4).tolist()) for i in range(n)]
    c = spark.createDataFrame(rows, "did string, grp string, vec array<double>")
    q = c.select(F.col("did").alias("qid"), "grp", "vec")
    pairs = _pairs_grouped(q, c, ["grp"], 4, 1 << 20, 16, False)
    hot_pairs = pairs.where("grp = 'hot'")
    assert hot_pairs.select("cb").distinct().count() == 300 // 16 + 1  # one join key per chunk
    # tiny test data: keep AQE from merging partitions / broadcasting rows that are MBs each at scale
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # tag partitions before filtering (no filter push-down through the tag)
        tagged = pairs.select("grp", F.spark_partition_id().alias("p"))
        parts = tagged.where("grp = 'hot'").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts > 2
    got = search(q, c, 3, group_cols=["grp"], chunk_rows=16)
    assert got.where("grp = 'hot'").count() == hot * 3
