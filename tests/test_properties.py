"""Properties from the test strategy: monotone recall, bounded metrics, V4 = V2."""

import pandas as pd
from pyspark.sql import functions as F

from rankwell.operators import metrics as M
from rankwell.operators.candidates import candidate_pairs
from rankwell.operators.rank import top_k
from rankwell.operators.score import search
from rankwell.sources.families import vec_family

SF001 = "/root/testdata/sf0.001"


def test_metric_properties(spark):
    fam = vec_family(spark, SF001)
    run = search(fam.queries, fam.corpus, 50, exclude_identical=True)
    pq = M.per_query(run, fam.qrels, (1, 3, 5, 10, 20, 50)).toPandas()
    for m in M.METRICS:
        assert ((pq[m] >= -1e-12) & (pq[m] <= 1 + 1e-12)).all(), m
    for col in ("recall", "cv_recall", "mrr"):
        w = pq.pivot(index="qid", columns="k", values=col)
        assert (w.diff(axis=1).fillna(0) >= -1e-12).all().all(), col


def test_blocked_scorer_equals_expression_scorer(spark):
    fam = vec_family(spark, SF001)
    blocked = search(fam.queries, fam.corpus, 7)
    ids = fam.queries.select("qid")
    all_pairs = ids.join(fam.corpus.select(F.col("did")), F.lit(True))  # small fixture: every pair listed
    expr = top_k(candidate_pairs(all_pairs, fam.queries, fam.corpus), 7)
    a = blocked.select("qid", "did", "rk").toPandas().sort_values(["qid", "rk"]).reset_index(drop=True)
    b = expr.select("qid", "did", "rk").toPandas().sort_values(["qid", "rk"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
