"""Registered queries: one per operator group, over the driver's test tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns match the oracle SQL of the same name in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compose_text
from ..operators import metrics as M
from ..operators.audit import dataset_stats as stats_op
from ..operators.audit import run_qrels_audit as audit_op
from ..operators.fusion import fuse, jaccard_scorer, score_with
from ..operators.prep import flatten_sequences, modality_groups as modality_groups_op, resolve_prompts, with_prompt_text
from ..operators.candidates import candidate_pairs, drop_identical, filter_lenient, filter_strict
from ..operators.nauc import confidence, nauc
from ..operators.embed import hashed_embedding as hashed_embedding_op
from ..operators.rank import rank, top_k
from ..operators.rank import skip_first as skip_first_hits
from ..operators.score import search
from ..functions.text import default_package
from ..plans.evaluate import RetrievalTask, score_run
from ..plans.evaluate import main_score as main_score_op
from ..session import SCORE_DECIMALS, cut_lineage, scratch_path
from ..plans import roundtrips, store
from ..plans.store import sweep_report as sweep_op
from ..plans.store import wide_metrics
from ..sources.families import mem_candidates, mem_family, mem_qrels, mem_turns, txt_family, txt_qrels, txt_tables, vec_family
from ..sources.files import file_position, last_wins, load_counts as load_counts_op
from ..sources.files import qrels_from_json_rows, qrels_to_json_rows, rename_text_to_data
from ..streaming.topk import run_to_table, stream_topk as stream_topk_op

FLAGSHIP_K = 10
FLAGSHIP_KS = (1, 3, 5, 10)


def flagship_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: exact cosine top-10 (identical id excluded) -> mean metrics at 1,3,5,10."""
    fam = vec_family(spark, sf_dir)
    run = search(fam.queries, fam.corpus, FLAGSHIP_K, exclude_identical=True)
    return M.evaluate(run, fam.qrels, FLAGSHIP_KS, ranked=True)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: the exact cosine top-10 run itself."""
    fam = vec_family(spark, sf_dir)
    return shown(search(fam.queries, fam.corpus, FLAGSHIP_K, exclude_identical=True))


def shown(run: DataFrame) -> DataFrame:
    """A run as the queries show it: scores with ``SCORE_DECIMALS`` decimals (stored ones are not rounded)."""
    return run.select("qid", "did", F.round("score", SCORE_DECIMALS).alias("score"), "rk")


def _vec_run(spark, sf_dir, k=FLAGSHIP_K, **kw):
    fam = vec_family(spark, sf_dir)
    return fam, search(fam.queries, fam.corpus, k, **kw)


def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: plain dot-product top-10 (``do_norm=False``)."""
    return shown(_vec_run(spark, sf_dir, do_norm=False, exclude_identical=True)[1])


def blocked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: cosine top-10 forced through many query blocks and the salted
    (non-broadcast) block join; must equal ``cosine_topk``."""
    return shown(_vec_run(spark, sf_dir, exclude_identical=True, query_block_bytes=8 << 10, broadcast_bytes=0)[1])


def chunk_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 per (label part of the corpus, query), merged into the global top-10."""
    fam = vec_family(spark, sf_dir)
    parts = search(fam.queries, fam.corpus, FLAGSHIP_K, corpus_part="label", exclude_identical=True)
    return shown(top_k(parts.drop("rk"), FLAGSHIP_K))


def zero_vector_and_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V3 edge cases: the embeddings plus a zero vector, a vector holding NaN and
    two equal vectors (ids d9 / d10), all searched against each other, top-5."""
    fam = vec_family(spark, sf_dir)
    extra = (
        fam.queries.agg(F.max(F.size("vec")).alias("dim"))
        .select(F.inline(F.array(
            F.struct(F.lit("z0").alias("id"), F.array_repeat(F.lit(0.0), F.col("dim")).alias("vec")),
            F.struct(F.lit("n0").alias("id"), F.concat(F.array(F.lit(float("nan"))),
                                                        F.array_repeat(F.lit(0.1), F.col("dim") - 1)).alias("vec")),
            F.struct(F.lit("d9").alias("id"), F.array_repeat(F.lit(0.125), F.col("dim")).alias("vec")),
            F.struct(F.lit("d10").alias("id"), F.array_repeat(F.lit(0.125), F.col("dim")).alias("vec")),
        )))
    )
    base = fam.queries.select(F.col("qid").alias("id"), F.col("vec").cast("array<double>"))
    allv = base.unionByName(extra)
    run = search(allv.withColumnRenamed("id", "qid"), allv.withColumnRenamed("id", "did"), 5, exclude_identical=True)
    return shown(run)


def nauc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 / M8: nAUC of ndcg, map, recall, precision and mrr at 1,3,5,10 for the
    max / std / diff1 confidence signals (VEC top-10 run)."""
    fam, run = _vec_run(spark, sf_dir, exclude_identical=True)
    run = cut_lineage(run)  # the run feeds both the metrics and the confidences
    return nauc(M.to_long(M.per_query(run, fam.qrels, FLAGSHIP_KS, ranked=True)), confidence(run))


def metrics_all_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-query metrics at 1,3,5,10,20,100,1000 (VEC, depth 1000)."""
    fam, run = _vec_run(spark, sf_dir, k=1000, exclude_identical=True)
    return M.to_long(M.per_query(run, fam.qrels, M.DEFAULT_K_VALUES, ranked=True))


def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 ties: documents searched against documents (hashed bag of words);
    exact copies score equal and are ordered by the larger id; top-5."""
    fam = txt_family(spark, sf_dir)
    q = fam.corpus.select(F.col("did").alias("qid"), "vec")
    return shown(search(q, fam.corpus, 5, exclude_identical=True))


def embed_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 + search: benchmark passages vs documents, hashed bag of words, top-10."""
    fam = txt_family(spark, sf_dir)
    return shown(search(fam.queries, fam.corpus, FLAGSHIP_K))


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 embedder output in long form: (did, bucket, cnt) for non-zero buckets."""
    fam = txt_family(spark, sf_dir)
    return fam.corpus.select("did", F.posexplode("vec").alias("bucket", "cnt")).where(F.col("cnt") > 0)


def contains_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT qrels: passages contained verbatim in documents (Aho-Corasick join)."""
    return txt_family(spark, sf_dir).qrels


def _txt_subset(spark, sf_dir, k):
    fam = txt_family(spark, sf_dir)
    run = search(fam.queries, fam.corpus, k, corpus_part="subset")
    qrels = fam.qrels.join(fam.corpus.select("did", "subset"), "did")
    return fam, run, qrels


def metrics_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT ranked separately per document language, metrics per subset."""
    _, run, qrels = _txt_subset(spark, sf_dir, 100)
    return M.evaluate(run, qrels, (1, 3, 5, 10, 20, 100), keys=["subset"], ranked=True)


def main_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task's main score (ndcg_at_10) per subset."""
    _, run, qrels = _txt_subset(spark, sf_dir, 10)
    task = RetrievalTask(name="TXT", main_metric="ndcg_at_10", k_values=(10,))
    return main_score_op(M.evaluate(run, qrels, task.k_values, keys=["subset"], ranked=True), task)


def mean_by_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: TXT means over evaluated queries and over all qrels queries."""
    fam = txt_family(spark, sf_dir)
    run = search(fam.queries, fam.corpus, 1000)
    pq = cut_lineage(M.per_query(run, fam.qrels, M.DEFAULT_K_VALUES, ranked=True))
    ev = M.mean(pq).withColumn("denominator", F.lit("evaluated"))
    qr = M.mean(pq, denominator="qrels", qrels=fam.qrels).withColumn("denominator", F.lit("qrels"))
    return ev.unionByName(qr)


def candidates_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM, score only each query's candidate turns, top-10."""
    fam = mem_family(spark, sf_dir)
    scored = candidate_pairs(fam.candidates, fam.queries, fam.corpus)
    return shown(top_k(scored, FLAGSHIP_K))


def _listed(turns: DataFrame, dids: DataFrame) -> DataFrame:
    """Candidate lists: the turns of the query's conversation that are not system turns."""
    spoken = turns.where(F.col("role") != "system").select(F.col("id").alias("did"))
    return dids.join(spoken, "did", "left_semi")


def candidates_post_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncut MEM run of each conversation, filtered to the candidate lists
    (its turns but system turns; every query has a list), re-ranked, top-10."""
    fam = mem_family(spark, sf_dir)
    run = candidate_pairs(fam.candidates, fam.queries, fam.corpus)  # T3: all turns of the conversation
    kept = filter_strict(run, _listed(mem_turns(spark, sf_dir), fam.candidates))
    return shown(top_k(kept, FLAGSHIP_K))


def candidates_post_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncut MEM run of each conversation; only conversations with a system turn
    have candidate lists, the other queries keep all their hits.  Re-ranked."""
    fam = mem_family(spark, sf_dir)
    turns = mem_turns(spark, sf_dir)
    run = candidate_pairs(fam.candidates, fam.queries, fam.corpus)
    with_sys = turns.where(F.col("role") == "system").select("conv_id").distinct()
    q_conv = turns.where(F.col("role") == "user").select(F.col("id").alias("qid"), "conv_id")
    listed = _listed(turns, fam.candidates).join(q_conv.join(with_sys, "conv_id", "left_semi").select("qid"), "qid", "left_semi")
    return shown(rank(filter_lenient(run, listed)))


def skip_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: VEC top-11 with the identical document kept; the first hit (normally
    the query itself) is dropped and the rest re-ranked."""
    _, run = _vec_run(spark, sf_dir, k=FLAGSHIP_K + 1)
    return shown(skip_first_hits(run))


def ignore_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 as a filter on a saved run: VEC top-11, hits with did = qid removed."""
    _, run = _vec_run(spark, sf_dir, k=FLAGSHIP_K + 1)
    return shown(drop_identical(run))




def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def compose_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title + " " + text; the title is the source except for English documents (null),
    and every language adds one row without text and one without either.  Whole texts hashed."""
    d = _docs(spark, sf_dir)
    title = F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("source"))
    rows = d.select(F.col("doc_id").cast("string").alias("did"), title.alias("title"), "text")
    none = F.lit(None).cast("string")
    bare = d.select("lang").distinct().select(F.explode(F.array(
        F.struct(F.concat(F.lit("t-"), F.col("lang")).alias("did"), F.col("lang").alias("title"), none.alias("text")),
        F.struct(F.concat(F.lit("n-"), F.col("lang")).alias("did"), none.alias("title"), none.alias("text")))).alias("r")).select("r.*")
    out = rows.unionByName(bare).select("did", compose_text("title", "text").alias("t"))
    return out.select("did", F.length("t").cast("bigint").alias("text_len"), F.md5("t").alias("text_md5"))


def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, the last one in file order wins."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text", file_position().alias("_pos"))
    kept = last_wins(raw, ["conv_id"])
    return kept.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def drop_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop ``_id``, rename ``text`` to ``data``."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", "lang",
                                   F.col("source").alias("_id"))
    r = rename_text_to_data(d)
    return r.select("id", "lang", F.md5("data").alias("data_md5"))


def qrels_json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM and TXT qrels packed into one JSON object per query."""
    mem = mem_qrels(mem_turns(spark, sf_dir))
    txt = txt_qrels(*txt_tables(spark, sf_dir))
    return qrels_to_json_rows(mem.unionByName(txt))


def qrels_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, data JSON {key: int})`` rows flattened (events.props)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("props").alias("data"))
    return qrels_from_json_rows(ev)


def sequence_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences [url, image, html, thumbnail] per page -> text parts each
    followed by a space, the first image, its package defaulting to "images"."""
    pg = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = F.lit(None).cast("string")
    items = F.array(
        F.struct(F.col("url").alias("text"), none.alias("path"), none.alias("package")),
        F.struct(none.alias("text"), F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"),
                 F.when(F.col("url").startswith("https"), F.lit("secure")).alias("package")),
        F.struct(F.col("html").alias("text"), none.alias("path"), none.alias("package")),
        F.struct(none.alias("text"), F.concat(F.lit("thumb/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"),
                 F.lit("thumbs").alias("package")),
    )
    flat = flatten_sequences(pg.select("page_id", items.alias("items")), "items")
    return flat.select(
        "page_id",
        F.length("seq_text").cast("bigint").alias("seq_len"),
        F.md5("seq_text").alias("seq_md5"),
        F.col("seq_image.path").alias("image_path"),
        default_package(F.col("seq_image.package"), "images").alias("image_package"),
    )


def modality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed table (documents TEXT, pages IMAGE, turns SEQ) split by
    modality and concatenated in the order TEXT, IMAGE, SEQ."""
    d = _docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                                   F.lit("TEXT").alias("modal"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("IMAGE").alias("modal"))
    c = mem_turns(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id")).alias("id"), F.lit("SEQ").alias("modal"))
    mixed = c.unionByName(p).unionByName(d)
    return modality_groups_op(mixed).select("id", "modal", "grp")


# Fixed prompt configuration of the prompt-resolution query.
PROMPTS = [
    ("task_side", "MEM", "query", "Q: "),
    ("type", "Retrieval", None, "Represent: "),
    ("side", None, "document", "D: "),
]


def prompt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt by priority task+side, task, type+side, type, side for every turn."""
    t = mem_turns(spark, sf_dir).select(
        "id", "text",
        F.lit("MEM").alias("task"),
        F.when(F.col("role") == "system", "Chat").otherwise("Retrieval").alias("task_type"),
        F.when(F.col("role") == "user", "query").otherwise("document").alias("side"),
    )
    r = with_prompt_text(resolve_prompts(t, PROMPTS))
    return r.select("id", "prompt", F.md5("input").alias("input_md5"))


def run_qrels_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncut MEM run of each conversation, filtered to the lists without system
    turns, audited against the qrels; queries of conversations that only have one such turn
    besides the query itself get an empty list."""
    fam = mem_family(spark, sf_dir)
    turns = mem_turns(spark, sf_dir)
    run = drop_identical(candidate_pairs(fam.candidates, fam.queries, fam.corpus))
    lists = _audit_lists(turns, fam.candidates)
    kept = filter_strict(run, lists)
    return audit_op(kept, fam.qrels, lists, run_qids=fam.queries.select("qid"))


def _audit_lists(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lists of the assistant turns after the query's; a query that has none keeps an empty list (null did)."""
    pos = turns.select(F.col("id").alias("did"), "role", F.col("turn").alias("d_turn"))
    mine = turns.select(F.col("id").alias("qid"), F.col("turn").alias("q_turn"))
    later = candidates.join(pos, "did").join(mine, "qid").where("role = 'assistant' and d_turn > q_turn").select("qid", "did")
    queries = turns.where("role = 'user'").select(F.col("id").alias("qid"))
    return queries.join(later, "qid", "left").select("qid", "did")


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset statistics of the TXT and MEM families."""
    bench, docs = txt_tables(spark, sf_dir)
    turns = mem_turns(spark, sf_dir)

    def tag(df, fam):
        return df.withColumn("family", F.lit(fam))

    user = turns.where("role = 'user'").select(F.col("id").alias("qid"), "text")
    q = tag(bench.select("qid", "text"), "TXT").unionByName(tag(user, "MEM"))
    c = tag(docs.select("did", "text"), "TXT").unionByName(tag(turns.select(F.col("id").alias("did"), "text"), "MEM"))
    r = tag(txt_qrels(bench, docs), "TXT").unionByName(tag(mem_qrels(turns), "MEM"))
    return stats_op(q, c, r, keys=["family"])


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the load-only pass - row counts per family and side, from the raw tables."""
    bench, docs = txt_tables(spark, sf_dir)
    turns = mem_turns(spark, sf_dir)
    sides = {"TXT": {"query": bench, "corpus": docs, "qrels": txt_qrels(bench, docs)},
             "MEM": {"query": turns.where("role = 'user'"), "corpus": turns, "qrels": mem_qrels(turns)}}
    out = None
    for name, tables in sides.items():
        c = load_counts_op(tables).withColumn("family", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out.select("family", "side", "n")


def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors of each document (hashed text, hashed source and language) summed, then top-5."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", F.concat_ws(" ", "source", "lang").alias("tags"))
    a = hashed_embedding_op(d.select("id", "text"), "text", 64).select("id", "vec")
    b = hashed_embedding_op(d.select("id", "tags"), "tags", 64).select("id", "vec")
    fused = cut_lineage(fuse(a, b))
    run = search(fused.withColumnRenamed("id", "qid"), fused.withColumnRenamed("id", "did"), 5, exclude_identical=True)
    return shown(run)


def pair_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: MEM candidate pairs scored by a user pair scorer (token Jaccard), top-5."""
    fam = mem_family(spark, sf_dir)
    pairs = (
        fam.candidates.join(fam.queries.select("qid", F.col("text").alias("q_text")), "qid")
        .join(fam.corpus.select("did", F.col("text").alias("d_text")), "did")
    )
    scored = score_with(pairs, jaccard_scorer)
    return shown(top_k(scored.select("qid", "did", "score"), 5))


def custom_metric_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM metrics plus a task hook (share of the top-k hits spoken by the assistant)."""
    fam = mem_family(spark, sf_dir)
    run = cut_lineage(top_k(candidate_pairs(fam.candidates, fam.queries, fam.corpus), FLAGSHIP_K))
    roles = mem_turns(spark, sf_dir).select(F.col("id").alias("did"), "role")

    def assistant_share(hits: DataFrame) -> DataFrame:
        spoken = (F.col("role") == "assistant").cast("double")
        per = hits.join(roles, "did").groupBy("qid").agg(
            *[F.sum(F.when(F.col("rk") <= k, spoken).otherwise(0.0)).alias(f"s{k}") for k in FLAGSHIP_KS])
        rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / k).alias("v")) for k in FLAGSHIP_KS])
        return per.select(F.inline(rows)).groupBy("k").agg(F.avg("v").alias("value")).select(
            F.lit("assistant_share").alias("metric"), "k", "value")

    task = RetrievalTask(name="MEM", k_values=FLAGSHIP_KS)
    return score_run(run, fam.qrels, task, with_nauc=False, hook=assistant_share, run_qids=fam.queries.select("qid"))


def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 shape: VEC flagship metrics as one row with one column per ``metric_at_k``."""
    m = flagship_eval(spark, sf_dir).withColumn("task", F.lit("VEC"))
    return wide_metrics(m, keys=["task"])


SWEEP_DIMS = (16, 32, 64)
STREAM_FILES = 4


def _widths(df: DataFrame, keep: list[str]) -> dict[int, DataFrame]:
    """Hashed vectors of several widths from one pass over the texts.

    The widths divide the largest one, and a bucket is a remainder: the narrower
    vectors are folded sums of the widest.
    """
    widest = max(SWEEP_DIMS)
    base = cut_lineage(hashed_embedding_op(df, "text", widest).select(*keep, "vec"))

    def folded(dim):
        parts = [F.slice("vec", i * dim + 1, dim) for i in range(widest // dim)]
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, lambda x, y: x + y)
        return base.select(*keep, out.alias("vec"))

    return {dim: folded(dim) for dim in SWEEP_DIMS}


def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed-embedding models (16/32/64 buckets) x tasks (TXT, MEM) -> ndcg_at_10.

    Tokens are hashed once for all widths, and the qrels are built once."""
    bench, docs = txt_tables(spark, sf_dir)
    turns = mem_turns(spark, sf_dir)
    txt, mem, cand = txt_qrels(bench, docs), mem_qrels(turns), mem_candidates(turns)
    tq, tc, mt = _widths(bench, ["qid"]), _widths(docs, ["did"]), _widths(turns, ["id", "role"])
    parts = []
    for dim in SWEEP_DIMS:
        trun = search(tq[dim], tc[dim], FLAGSHIP_K)
        user = mt[dim].where("role = 'user'").select(F.col("id").alias("qid"), "vec")
        mrun = top_k(candidate_pairs(cand, user, mt[dim].select(F.col("id").alias("did"), "vec")), FLAGSHIP_K)
        for task, run, qrels in (("TXT", trun, txt), ("MEM", mrun, mem)):
            parts.append(M.evaluate(run, qrels, (10,), ranked=True).select(
                "metric", "k", "value", F.lit(task).alias("task"), F.lit(f"hashed-{dim}").alias("model")))
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    return sweep_op(allm)


def stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a file stream of several micro-batches, one of them delivered twice;
    incremental top-10 per query kept as state; the final rankings equal the batch ``cosine_topk``."""
    # state partitions are fixed when a stream starts; size them to the cluster,
    # not to whatever the batch session uses, in a session of their own
    ss = spark.newSession()
    ss.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    fam = vec_family(ss, sf_dir)
    base = scratch_path(ss, "stream-source")
    emb = ss.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    files = emb.withColumn("part", F.pmod("vec_id", F.lit(STREAM_FILES)))
    files = files.unionByName(files.where("part = 0").withColumn("part", F.lit(STREAM_FILES)))  # delivered again
    files.repartition(STREAM_FILES + 1, "part").write.partitionBy("part").parquet(base)
    stream = (ss.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(base)
              .select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec")))
    updates = stream_topk_op(stream, fam.queries, FLAGSHIP_K, exclude_identical=True)
    return shown(run_to_table(updates))


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 / K4 / K5: plan = hashed models x TXT subsets (document languages).  The
    64-bucket model is evaluated: its run is saved and reloaded, its per-subset
    metrics saved and reloaded from the results store; every plan entry is then
    reported as done (with the stored ndcg_at_10) or pending."""
    root = scratch_path(spark, "results")
    fam = txt_family(spark, sf_dir)
    model, task = "hashed-64", "TXT"
    run = search(fam.queries, fam.corpus, FLAGSHIP_K, corpus_part="subset")
    store.save_run(run, f"{root}/runs", model, task)
    saved = store.load_run(spark, f"{root}/runs", model, task).select("subset", "qid", "did", "score")
    qrels = fam.qrels.join(fam.corpus.select("did", "subset"), "did")
    metrics = M.evaluate(saved, qrels, (10,), keys=["subset"])
    store.save_metrics(metrics, f"{root}/metrics", model, task)
    done = store.load_metrics(spark, f"{root}/metrics", model, task).select(
        F.lit(model).alias("model"), F.lit(task).alias("task"), "subset", "metric", "k", "value")
    subsets = fam.corpus.select("subset").distinct()
    plan = _plan(subsets, [f"hashed-{d}" for d in SWEEP_DIMS], task)
    todo = store.pending(plan, done).withColumn("status", F.lit("pending")).withColumn(
        "ndcg_at_10", F.lit(None).cast("double"))
    got = done.where((F.col("metric") == "ndcg") & (F.col("k") == 10)).select(
        "model", "task", "subset", F.lit("done").alias("status"), F.col("value").alias("ndcg_at_10"))
    return got.unionByName(todo.select("model", "task", "subset", "status", "ndcg_at_10"))


def _plan(subsets: DataFrame, models: list[str], task: str) -> DataFrame:
    """Every model for every subset: the model list is a fixed configuration, so it
    is expanded per subset row as an array (no join)."""
    return subsets.select(F.explode(F.array(*[F.lit(n) for n in models])).alias("model"), F.lit(task).alias("task"),
                          "subset")


REGISTRY = {
    "flagship_eval": flagship_eval,
    "cosine_topk": cosine_topk,
    "dot_topk": dot_topk,
    "blocked_topk": blocked_topk,
    "chunk_merge_topk": chunk_merge_topk,
    "zero_vector_and_nan": zero_vector_and_nan,
    "nauc_all": nauc_all,
    "metrics_all_k": metrics_all_k,
    "topk_ties": topk_ties,
    "embed_and_search": embed_and_search,
    "hashed_embedding": hashed_embedding,
    "contains_qrels": contains_qrels,
    "metrics_by_subset": metrics_by_subset,
    "main_score": main_score,
    "mean_by_denominator": mean_by_denominator,
    "candidates_pre": candidates_pre,
    "candidates_post_strict": candidates_post_strict,
    "candidates_post_lenient": candidates_post_lenient,
    "skip_first": skip_first,
    "ignore_identical": ignore_identical,
    "compose_text": compose_text_q,
    "dedupe_last_wins": dedupe_last_wins,
    "drop_rename": drop_rename,
    "qrels_json_pack": qrels_json_pack,
    "qrels_json_explode": qrels_json_explode,
    "sequence_flatten": sequence_flatten,
    "modality_groups": modality_groups,
    "prompt_resolution": prompt_resolution,
    "run_qrels_audit": run_qrels_audit,
    "dataset_stats": dataset_stats,
    "load_counts": load_counts,
    "late_fusion": late_fusion,
    "pair_scoring": pair_scoring,
    "custom_metric_hook": custom_metric_hook,
    "metrics_wide": metrics_wide,
    "sweep_report": sweep_report,
    "stream_topk": stream_topk,
    "resume_plan": resume_plan,
}
REGISTRY |= roundtrips.REGISTRY
