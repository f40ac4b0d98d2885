"""Mixed-modality embedding (F2 / U1) and per-key means with both denominators."""

import numpy as np
import pytest

from rankwell.operators import metrics as M
from rankwell.operators.embed import embed_mixed


def test_embed_mixed_routes_each_modality(spark):
    # factories defined here are shipped by value (workers cannot import this test module)
    def _text_model():
        return lambda inputs: np.array([[len(x), 1.0] for x in inputs.iloc[:, 0]])

    def _seq_model():
        return lambda inputs: np.array([[0.0, len(x)] for x in inputs.iloc[:, 0]])

    df = spark.createDataFrame([("1", "abc", "TEXT"), ("2", "x.png", "IMAGE"), ("3", "[\"a\"]", "SEQ")],
                               "id string, data string, modal string")
    got = {r.id: list(r.vec) for r in embed_mixed(df, {"TEXT": _text_model, "SEQ": _seq_model}).collect()}
    assert got == {"1": [3.0, 1.0], "3": [0.0, 5.0]}  # IMAGE has no embedder here: not embedded
    with pytest.raises(ValueError):
        embed_mixed(df, {})


def test_means_per_key_and_denominator(spark):
    run = spark.createDataFrame([("s1", "q1", "a", 0.9), ("s2", "q1", "b", 0.9)],
                                "subset string, qid string, did string, score double")
    qrels = spark.createDataFrame([("s1", "q1", "a", 1), ("s2", "q1", "x", 1), ("s2", "q9", "y", 1)],
                                  "subset string, qid string, did string, rel int")
    pq = M.per_query(run, qrels, (1,), keys=["subset"])
    ev = {(r.subset, r.metric): r.value for r in M.mean(pq, ["subset"]).collect()}
    qr = {(r.subset, r.metric): r.value for r in M.mean(pq, ["subset"], "qrels", qrels).collect()}
    assert ev[("s1", "recall")] == 1.0 and ev[("s2", "recall")] == 0.0
    assert qr[("s1", "recall")] == 1.0 and qr[("s2", "recall")] == 0.0  # s2: 0 / 2 qrels queries
    assert qr[("s1", "mrr")] == 1.0
