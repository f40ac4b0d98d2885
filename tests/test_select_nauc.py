"""Selection by rank and nAUC against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import nauc as N
from rankwell.operators import select as S

ROWS = "g string, key double, tie string"


def ranked(rows, ranks):
    by = {}
    for g, key, tie in rows:
        by.setdefault(g, []).append((key, tie))
    return sorted((g, i, *sorted(v)[min(round(i * 0.1 * len(v)), len(v) - 1)]) for g, v in by.items() for i in range(ranks))


@pytest.mark.parametrize("direct", [1 << 17, 150])
def test_pick_equals_sorting(spark, monkeypatch, direct):
    """Also with groups far above ``DIRECT_ROWS``, one of them nearly all ties: samples narrow each rank down."""
    monkeypatch.setattr(S, "DIRECT_ROWS", direct)
    monkeypatch.setattr(S, "SAMPLE_ROWS", 64)
    r = np.random.default_rng(5)
    rows = [("a", float(r.random()), f"q{i}") for i in range(900)]
    rows += [("ties", float(i % 50 == 0), f"q{i}") for i in range(700)] + [("one", 1.0, "x")] + [("few", float(i % 3), f"y{i}") for i in range(11)]
    got = S.pick(spark.createDataFrame(rows, ROWS).repartition(5), ["g"], 10, N._drops).collect()
    assert sorted(tuple(x) for x in got) == ranked(rows, 10)


def test_pick_without_rows(spark):
    assert S.pick(spark.createDataFrame([], ROWS), ["g"], 10, N._drops).collect() == []


def plain_nauc(values, conf):
    """Curve, area and nAUC of one metric: values and confidences by query id."""
    n = len(values)

    def area(order):
        curve = [np.mean([values[q] for q in order[min(round(i * 0.1 * n), n - 1):]]) for i in range(10)]
        return sum(((i + 1) * 0.1 - i * 0.1) * (curve[i] + curve[i + 1]) / 2 for i in range(9)), curve[0] * 0.9

    auc, flat = area(sorted(values, key=lambda q: (conf[q], q)))
    best, _ = area(sorted(values, key=lambda q: (values[q], q)))
    return None if abs(best - flat) < 1e-12 else round((auc - flat) / (best - flat), 9)


@pytest.mark.parametrize("direct", [1 << 17, 60])
def test_nauc_equals_the_plain_form(spark, monkeypatch, direct):
    monkeypatch.setattr(S, "DIRECT_ROWS", direct)
    monkeypatch.setattr(S, "SAMPLE_ROWS", 32)
    r = np.random.default_rng(6)
    qids = {"s": [f"q{i}" for i in range(137)], "t": ["a", "b"], "": ["z"]}
    long, conf, want = [], [], {}
    for s, ids in qids.items():
        signals = {x: {q: float(r.integers(0, 4)) / 4 for q in ids} for x in N.SIGNALS}
        conf += [(s, q, *(signals[x][q] for x in N.SIGNALS)) for q in ids if q != "q3"]
        for x in N.SIGNALS:
            signals[x]["q3"] = 0.0  # no confidence counts as 0
        for metric, k in (("ndcg", 1), ("ndcg", 10), ("mrr", 1), ("map", 1)):
            values = {q: 1.0 if metric == "map" else round(float(r.random()), 2) for q in ids}
            long += [(s, metric, k, q, v) for q, v in values.items()]
            for x in N.SIGNALS:
                want[s, metric, k, x] = plain_nauc(values, signals[x])
    got = N.nauc(spark.createDataFrame(long, "subset string, metric string, k int, qid string, value double"),
                 spark.createDataFrame(conf, "subset string, qid string, max double, std double, diff1 double"), ["subset"]).collect()
    found = {(x["subset"], x["metric"], x["k"], x["signal"]): x["value"] for x in got}
    assert found.keys() == want.keys()
    for key, v in want.items():
        assert found[key] == (None if v is None else pytest.approx(v, abs=2e-9)), key


def test_nauc_sorts_no_large_group(spark):
    rows = spark.range(50).select(F.lit("ndcg").alias("metric"), F.lit(1).alias("k"), F.col("id").cast("string").alias("qid"), F.rand(1).alias("value"))
    conf = rows.select("qid", *(F.rand(2).alias(s) for s in N.SIGNALS))
    plan = N.nauc(rows, conf)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
