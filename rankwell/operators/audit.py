"""Run / qrels audits and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tag(df: DataFrame, check: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "qid").distinct().withColumn("check", F.lit(check))


def run_qrels_audit(
    run: DataFrame,
    qrels: DataFrame,
    candidates: DataFrame | None = None,
    run_qids: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``(keys, check, qid)`` for every query flagged by an anti join:

    * ``only_in_run``      query has hits but no qrels rows
    * ``only_in_qrels``    query judged but absent from the run
    * ``no_positive``      query judged, none with rel > 0
    * ``empty_hits``       query the run was made for, no hit left (after filtering)
    * ``empty_candidates`` query whose candidate list is empty
    """
    keys = list(keys)
    rq = run.select(*keys, "qid").distinct()
    qq = qrels.select(*keys, "qid").distinct()
    parts = [
        _tag(rq.join(qq, [*keys, "qid"], "left_anti"), "only_in_run", keys),
        _tag(qq.join(rq, [*keys, "qid"], "left_anti"), "only_in_qrels", keys),
        _tag(qq.join(qrels.where(F.col("rel") > 0).select(*keys, "qid"), [*keys, "qid"], "left_anti"),
             "no_positive", keys),
    ]
    if run_qids is not None:
        parts.append(_tag(run_qids.select(*keys, "qid").distinct().join(rq, [*keys, "qid"], "left_anti"),
                          "empty_hits", keys))
    if candidates is not None:
        listed = candidates.groupBy(*keys, "qid").agg(F.count("did").alias("n"))
        parts.append(_tag(listed.where(F.col("n") == 0), "empty_candidates", keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "check", "qid")


def audit_counts(audit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return audit.groupBy(*keys, "check").agg(F.count(F.lit(1)).alias("n"))


def dataset_stats(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, keys: Sequence[str] = (),
                  q_text: str = "text", d_text: str = "text") -> DataFrame:
    """n_samples, num_documents, num_queries, average document / query length
    (characters), average relevant documents (rel > 0) per query."""
    keys = list(keys)
    q = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_queries"),
                                   F.avg(F.length(q_text)).alias("average_query_length"))
    d = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_documents"),
                                  F.avg(F.length(d_text)).alias("average_document_length"))
    r = qrels.groupBy(*keys).agg(F.sum((F.col("rel") > 0).cast("long")).alias("_nrel"))
    joined = q.join(d, keys) if keys else q.unionByName(d, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("num_queries", "average_query_length", "num_documents",
                                      "average_document_length")])
    if keys:
        joined = joined.join(r, keys, "left")
    else:
        joined = joined.unionByName(r, allowMissingColumns=True).agg(
            *[F.max(c).alias(c) for c in ("num_queries", "average_query_length", "num_documents",
                                          "average_document_length", "_nrel")])
    return joined.select(
        *keys,
        (F.col("num_queries") + F.col("num_documents")).alias("n_samples"),
        "num_documents",
        "num_queries",
        F.round("average_document_length", 9).alias("average_document_length"),
        F.round("average_query_length", 9).alias("average_query_length"),
        F.round(F.coalesce(F.col("_nrel"), F.lit(0)) / F.col("num_queries"), 9).alias("average_relevant_docs_per_query"),
    )
