"""Task specification and the evaluation lifecycle.

``RetrievalTask`` is the driver-side task description (name, data sources,
main metric, cut-offs, identical-id handling).  ``evaluate`` builds plans from
inputs to metrics:

    queries/corpus -> prompts -> embeddings (saved, reused) -> blocked top-k
    search, or listed pairs, a pair scorer or a user's search -> run (saved,
    reused) -> per-query metrics -> means (+ nAUC, + task hook) -> metrics

Every stage is stored per subset, with an entry in a manifest (``plans.store``) once
it is complete.  What is stored for the same inputs and settings is used, and only
the rest is computed: a failure restarts from the last complete stage, embeddings
from the last committed chunk, and a subset that is added later is evaluated by
itself.  Inputs are told by their rows, functions (embedders, searches, hooks) only
by the model's name: a changed function needs a new name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.candidates import candidate_pairs, drop_identical
from ..operators.embed import EmbedderFactory, embed, embed_mixed
from ..operators.fusion import PairScorerFactory, score_with
from ..operators.nauc import confidence, nauc
from ..operators.prep import resolve_prompts
from ..operators.rank import skip_first, top_k
from ..operators.score import search
from . import store

MetricHook = Callable[[DataFrame], DataFrame]  # judged run -> (metric, k, value)


@dataclass(frozen=True)
class RetrievalTask:
    name: str
    data: dict = field(default_factory=dict)
    main_metric: str = "ndcg_at_10"
    k_values: Sequence[int] = M.DEFAULT_K_VALUES
    ignore_identical_ids: bool = False
    skip_first_result: bool = False
    chunk_size: int = 100_000  # rows of an embedding commit

    @classmethod
    def from_config(cls, path: str) -> "RetrievalTask":
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @classmethod
    def from_dict(cls, cfg: dict) -> "RetrievalTask":
        known = {k: v for k, v in cfg.items() if k in cls.__dataclass_fields__}
        if "k_values" in known:
            known["k_values"] = tuple(int(k) for k in known["k_values"])
        return cls(**known)

    @property
    def depth(self) -> int:
        return max(self.k_values)

    @property
    def search_depth(self) -> int:
        """Hits to retrieve so that ``depth`` are left after the task's own removals."""
        return self.depth + int(self.ignore_identical_ids) + int(self.skip_first_result)

    def main_key(self) -> tuple[str, int]:
        metric, k = self.main_metric.rsplit("_at_", 1)
        return metric, int(k)


def main_score(metrics: DataFrame, task: RetrievalTask) -> DataFrame:
    """The task's main score per subset."""
    metric, k = task.main_key()
    keys = [c for c in metrics.columns if c not in ("metric", "k", "value")]
    return metrics.where((F.col("metric") == metric) & (F.col("k") == k)).select(
        *keys, F.lit(task.main_metric).alias("main_metric"), "value")


def score_run(
    run: DataFrame,
    qrels: DataFrame,
    task: RetrievalTask,
    keys: Sequence[str] = (),
    run_qids: DataFrame | None = None,
    with_nauc: bool = True,
    hook: MetricHook | None = None,
    denominator: str = "evaluated",
) -> DataFrame:
    """Run -> long metrics ``(keys, metric, k, value)`` incl. nAUC names and the hook's rows."""
    keys = list(keys)
    if run_qids is None:  # the queries before any hit is removed
        run_qids = run.select(*keys, "qid").distinct()
    if task.ignore_identical_ids:
        run = drop_identical(run)
    if task.skip_first_result:
        run = skip_first(run, [*keys, "qid"]).drop("rk")
    pq = M.per_query(run, qrels, task.k_values, keys, run_qids)
    out = M.mean(pq, keys, denominator, qrels)
    if with_nauc:
        na = nauc(M.to_long(pq, keys), confidence(run, keys), keys)
        out = out.unionByName(na.select(
            *keys, F.concat(F.lit("nauc_"), F.col("metric"), F.lit(":"), F.col("signal")).alias("metric"), "k", "value"
        ))
    if hook is not None:
        hits = M.judged(run, qrels, task.depth, keys)
        extra = hook(hits)
        out = out.unionByName(extra.select(*keys, "metric", F.col("k").cast("int"), F.round("value", 9).alias("value")))
    return out


Retriever = Callable[[DataFrame, DataFrame, int, "DataFrame | None", Sequence[str]], DataFrame]


def pair_retriever(factory: PairScorerFactory, first: Retriever | None = None, first_depth: int = 100) -> Retriever:
    """a user pair scorer (cross-encoder) as a retriever.

    It scores the candidate lists.  Queries without lists need ``first``, another
    retriever whose ``first_depth`` best hits are scored again (retrieve and re-rank):
    a pair scorer has no vectors to search by, and all pairs would be queries x corpus.
    """

    def retrieve(queries: DataFrame, corpus: DataFrame, depth: int, candidates: DataFrame | None, keys: Sequence[str]) -> DataFrame:
        keys = list(keys)
        if candidates is None and first is None:
            raise ValueError("a pair scorer needs candidate lists or a first retriever")
        pairs = None
        if candidates is not None:
            pairs = candidates.where(F.col("did").isNotNull()).select(*keys, "qid", "did").distinct()
        if first is not None:
            free = queries
            if candidates is not None:
                free = queries.join(candidates.select(*keys, F.col("qid").alias("id")).distinct(), [*keys, "id"], "left_anti")
            found = first(free, corpus, max(depth, first_depth), None, keys).select(*keys, "qid", "did")
            pairs = found if pairs is None else pairs.unionByName(found)
        pairs = pairs.join(queries.select(*keys, F.col("id").alias("qid"), F.col("data").alias("q_text")), [*keys, "qid"])
        pairs = pairs.join(corpus.select(*keys, F.col("id").alias("did"), F.col("data").alias("d_text")), [*keys, "did"])
        return top_k(score_with(pairs, factory).select(*keys, "qid", "did", "score"), depth, keys=[*keys, "qid"])

    return retrieve


def dense_retriever(embedded, do_norm: bool = True, strict: bool = False) -> Retriever:
    """Blocked search over embedded sides; with candidates, listed pairs are scored directly.

    That equals full-depth retrieval followed by the filter.  Queries without a
    list are searched normally, or fail the job with ``strict``.
    """

    def retrieve(queries: DataFrame, corpus: DataFrame, depth: int, candidates: DataFrame | None, keys: Sequence[str]) -> DataFrame:
        keys = list(keys)
        q = embedded("query", queries).select(*keys, F.col("id").alias("qid"), "vec")
        c = embedded("collection", corpus).select(*keys, F.col("id").alias("did"), "vec")
        if candidates is None:
            return search(q, c, depth, do_norm=do_norm, group_cols=keys)
        listed = candidates.select(*keys, "qid").distinct()
        res = top_k(candidate_pairs(candidates, q.join(listed, [*keys, "qid"], "left_semi"), c, keys, do_norm), depth, keys=[*keys, "qid"])
        unlisted = q.join(listed, [*keys, "qid"], "left_anti")
        if not strict:
            return res.unionByName(search(unlisted, c, depth, do_norm=do_norm, group_cols=keys))
        fail = F.raise_error(F.concat(F.lit("query id missing from the candidate map: "), F.col("qid")))
        return res.unionByName(unlisted.select(
            *keys, fail.cast("string").alias("qid"), F.lit(None).cast("string").alias("did"),
            F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rk")))

    return retrieve


def prompted(df: DataFrame, side: str, task: RetrievalTask, prompts, task_type: str) -> DataFrame:
    """The prompt of the task and side in front of every text; a row's own ``prompt`` column comes first."""
    if "prompt" in df.columns:
        df = df.withColumnRenamed("prompt", "_own")
    elif not prompts:
        return df
    else:
        df = df.withColumn("_own", F.lit(None).cast("string"))
    tagged = df.withColumn("_task", F.lit(task.name)).withColumn("_type", F.lit(task_type)).withColumn("_side", F.lit(side))
    out = resolve_prompts(tagged, prompts or [], "_task", "_type", "_side")
    prompt = F.coalesce(F.col("_own"), F.col("prompt"), F.lit(""))
    return out.withColumn("data", F.concat(prompt, F.col("data"))).drop("_own", "_task", "_type", "_side", "prompt")


def evaluate(
    spark: SparkSession,
    task: RetrievalTask,
    model: str,
    embedder: "EmbedderFactory | dict[str, EmbedderFactory] | None",
    queries: DataFrame,
    corpus: DataFrame,
    qrels: "DataFrame | M.PairQrels | M.ClassQrels",
    output_dir: str,
    candidates: DataFrame | None = None,
    strict_candidates: bool = False,
    hook: MetricHook | None = None,
    by_subset: bool = False,
    subsets: Sequence[str] | None = None,
    prompts=None,
    task_type: str = "Retrieval",
    input_cols: tuple[str, ...] = ("data",),
    retriever: Retriever | None = None,
    denominator: str = "evaluated",
) -> DataFrame:
    """One task, one model, with every stage stored under ``output_dir``.

    ``queries``/``corpus`` carry ``(id, data)`` (further ``input_cols`` go to the
    embedder too); ``qrels`` ``(qid, did, rel)``; ``candidates`` (optional)
    ``(qid, did)``, a null did marking an empty list.  Means are over all queries
    of the query table that are judged: a query whose list is empty, or that
    finds nothing, counts with zeros.

    ``embedder`` is a factory, or one per modality for tables with a ``modal``
    column (MIXED).  ``retriever`` replaces embedding and search: a pair scorer
    (``pair_retriever``) or any function of (queries, corpus, depth, candidates,
    keys) that returns ``(keys, qid, did, score)`` (F4).  ``prompts`` is the
    prompt configuration of ``operators.prep.resolve_prompts``.

    ``by_subset``: all inputs carry a ``subset`` column; every subset is its
    own retrieval problem (its queries only meet its corpus) and gets its own
    metrics.  ``subsets`` selects some of them (P11).  Subsets whose metrics are
    stored are not computed again.  A null subset is the subset "".  Without
    queries or without documents there are no hits; judged queries count with zeros.
    """
    keys = ["subset"] if by_subset else []
    if by_subset:  # a null subset is the unnamed one
        queries, corpus, candidates = (None if x is None else x.withColumn("subset", store.subset_of(x)) for x in (queries, corpus, candidates))
        qrels = qrels.withColumn("subset", store.subset_of(qrels)) if isinstance(qrels, DataFrame) else qrels
    manifest = store.Manifest(spark, f"{output_dir}/manifest", model, task.name)
    inputs = [store.fingerprints(_one_subset(x, by_subset)) for x in (queries, corpus, candidates, qrels)]
    wanted = {""}
    if by_subset:
        wanted = set(inputs[0]) if subsets is None else set(inputs[0]) & set(subsets)
    stage = "full" if candidates is None else "filtered"  # K3: candidate-restricted predictions
    how = (task.search_depth, stage, strict_candidates, task_type, repr(prompts), tuple(input_cols), retriever is not None)
    run_marks = {s: store.mark_of(*(x.get(s) for x in inputs[:3]), *how) for s in wanted}
    settings = (tuple(task.k_values), task.ignore_identical_ids, task.skip_first_result, denominator, hook is not None)
    metric_marks = {s: store.mark_of(run_marks[s], inputs[3].get(s), *settings) for s in wanted}

    def only(df: DataFrame | None, names: set[str]) -> DataFrame | None:
        return df if df is None or not by_subset else df.where(F.col("subset").isin(sorted(names)))

    scores, runs = f"{output_dir}/metrics", f"{output_dir}/runs"
    todo = wanted - manifest.complete("metrics", metric_marks, scores, model=model, task=task.name)
    if todo:
        to_run = todo - manifest.complete(f"run-{stage}", run_marks, runs, model=model, task=task.name, stage=stage)
        if to_run:
            side_q = prompted(only(queries, to_run), "query", task, prompts, task_type)
            side_c = prompted(only(corpus, to_run), "document", task, prompts, task_type)

            def embedded(side: str, df: DataFrame) -> DataFrame:
                def fresh(part: DataFrame) -> DataFrame:
                    return embed_keyed(part, embedder, ["subset", "source"], input_cols)

                df = df if by_subset else df.drop("subset")
                got = store.embed_missing(df, fresh, f"{output_dir}/embeddings", model, task.name, side, input_cols, task.chunk_size, to_run)
                return got.where(F.col("subset").isin(sorted(to_run)))

            retrieve = retriever or dense_retriever(embedded, strict=strict_candidates)
            res = retrieve(side_q, side_c, task.search_depth, only(candidates, to_run), keys)
            if "rk" not in res.columns:
                res = top_k(res, task.search_depth, keys=[*keys, "qid"])
            store.drop_subsets(spark, runs, to_run, model=model, task=task.name, stage=stage)
            store.save_run(res, runs, model, task.name, stage)
            # a subset without hits has no rows; the manifest says that it is complete
            written = store.rows_per_subset(store.load_run(spark, runs, model, task.name, stage), to_run)
            manifest.commit(f"run-{stage}", written, {s: run_marks[s] for s in to_run})
        found = {s for s, (rows, _) in manifest.entries(f"run-{stage}").items() if rows and s in todo}
        run = store.load_run(spark, runs, model, task.name, stage) if found else None
        if run is None:  # no query found anything
            run = spark.createDataFrame([], store.RUN_SCHEMA)
        run = run.where(F.col("subset").isin(sorted(found))).select(*keys, "qid", "did", "score")
        run_qids = only(queries, todo).select(*keys, F.col("id").cast("string").alias("qid"))
        judged = qrels if not by_subset else qrels.where(F.col("subset").isin(sorted(todo)))
        metrics = score_run(run, judged, task, keys=keys, run_qids=run_qids, hook=hook, denominator=denominator)
        store.drop_subsets(spark, scores, todo, model=model, task=task.name)
        store.save_metrics(metrics, scores, model, task.name)
        done = store.rows_per_subset(store.load_metrics(spark, scores, model, task.name), todo)
        manifest.commit("metrics", done, {s: metric_marks[s] for s in todo})
    present = {s for s, (rows, _) in manifest.entries("metrics").items() if rows and s in wanted}
    out = store.load_metrics(spark, scores, model, task.name) if present else None
    if out is None:
        out = spark.createDataFrame([], store.METRICS_SCHEMA)
    return out.where(F.col("subset").isin(sorted(present))).select("subset", "metric", "k", "value")


def _one_subset(df, by_subset: bool):
    """An input as the manifest sees it: without ``by_subset`` a ``subset`` column is data like any other."""
    return df.withColumnRenamed("subset", "_subset") if isinstance(df, DataFrame) and not by_subset and "subset" in df.columns else df


def embed_keyed(df: DataFrame, embedder, keys: Sequence[str], input_cols: Sequence[str]) -> DataFrame:
    """``(keys, id, vec)``: the rows of each modality with its embedder, or all with one."""
    sep = "\u001f"
    src = df.withColumn("_key", F.concat_ws(sep, *keys, F.col("id").cast("string")))
    if isinstance(embedder, dict):
        vecs = embed_mixed(src, embedder, id_col="_key", input_cols=tuple(input_cols))
    else:
        vecs = embed(src, embedder, id_col="_key", input_cols=tuple(input_cols), sort_col=input_cols[0])
    if not keys:
        return vecs.withColumnRenamed("_key", "id")
    parts = F.split("_key", sep, len(keys) + 1)  # an id may hold the separator
    return vecs.select(*[F.get(parts, i).alias(k) for i, k in enumerate(keys)], F.get(parts, len(keys)).alias("id"), "vec")
