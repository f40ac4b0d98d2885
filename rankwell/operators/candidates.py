"""Candidate restriction of runs (J3a, J3b, J4) and identical-id removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import _block_counts, _with_blocks, score_pairs

# Most queries in a packed list of a document; a document listed by more gets as many lists as it needs.
LIST_BLOCK = 1024


def explode_candidates(lists: DataFrame, qid: str = "query_id", dids: str = "candidate_doc_ids",
                       keys: Sequence[str] = ()) -> DataFrame:
    """``(qid, array<did>)`` -> long ``(qid, did)``; empty lists keep a null did."""
    return lists.select(
        *keys,
        F.col(qid).cast("string").alias("qid"),
        F.explode_outer(F.col(dids).cast("array<string>")).alias("did"),
    )


def filter_strict(run: DataFrame, cand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep hits listed as candidates; a run qid without a list fails the job."""
    keys = list(keys)
    listed = cand.select(*keys, "qid").distinct()
    missing = run.select(*keys, "qid").distinct().join(listed, [*keys, "qid"], "left_anti")
    checked = run.join(
        missing.select(*keys, "qid", F.lit(True).alias("_missing")), [*keys, "qid"], "left"
    ).where(F.assert_true(F.col("_missing").isNull(), F.lit("query id missing from the candidate map")).isNull())
    pairs = cand.where(F.col("did").isNotNull()).select(*keys, "qid", "did")
    return checked.drop("_missing").join(pairs, [*keys, "qid", "did"], "left_semi")


def filter_lenient(run: DataFrame, cand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep listed hits; a qid without a list keeps all hits, an empty list keeps none.

    An empty candidate map (no rows at all) keeps the run unchanged, which the
    anti-join branch gives without a special case.
    """
    keys = list(keys)
    listed_q = cand.select(*keys, "qid").distinct()
    pairs = cand.where(F.col("did").isNotNull()).select(*keys, "qid", "did")
    kept = run.join(pairs, [*keys, "qid", "did"], "left_semi")
    passthrough = run.join(listed_q, [*keys, "qid"], "left_anti")
    return kept.unionByName(passthrough)


def candidate_pairs(cand: DataFrame, queries: DataFrame, corpus: DataFrame, keys: Sequence[str] = (),
                    do_norm: bool = True) -> DataFrame:
    """Score only the listed pairs (pre-filter).

    ``queries``/``corpus`` carry ``(keys, qid|did, vec)``.  With full-depth
    retrieval this equals retrieving everything and filtering afterwards.  The
    lists are packed per document first, so a document's vector is shuffled once
    per list, and pairs are scored in Arrow batches.  A document that many queries
    list is dealt into shares by its own count, about ``LIST_BLOCK`` / 2 queries
    each, before any list is built: no list grows with the number of queries.
    """
    keys = list(keys)
    q = queries.select(*keys, F.col("qid").cast("string").alias("qid"), F.col("vec").cast("array<double>").alias("q_vec"))
    d = corpus.select(*keys, F.col("did").cast("string").alias("did"), F.col("vec").cast("array<double>").alias("d_vec"))
    pairs = cand.where(F.col("did").isNotNull()).select(*keys, "qid", "did").dropDuplicates([*keys, "qid", "did"])
    doc = [*keys, "did"]
    counts = _block_counts(pairs, doc, LIST_BLOCK // 2, "shares")
    dealt = _with_blocks(pairs, counts, doc, "shares").withColumn("share", F.pmod(F.xxhash64("qid"), F.col("shares")))
    # an explicit shuffle on (document, share): one on the document alone would put a hot document into one task
    lists = dealt.repartition(*doc, "share").groupBy(*doc, "share").agg(F.collect_list("qid").alias("qids"))
    lists = lists.select(*doc, "qids").join(d, doc)
    joined = lists.select(*keys, "did", "d_vec", F.explode("qids").alias("qid")).join(q, [*keys, "qid"])
    return score_pairs(joined, do_norm=do_norm).select(*keys, "qid", "did", "score")


def drop_identical(run: DataFrame) -> DataFrame:
    """Remove hits whose document id equals the query id."""
    return run.where(F.col("qid") != F.col("did"))
