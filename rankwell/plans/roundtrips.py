"""Registered round trips: the given tables written as task files, read back, evaluated.

Every query writes whole tables under a scratch folder in the shared folder, in
the formats of the file sources, and runs the library's readers, package
fetches and lifecycle on them.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import candidate_pairs
from ..operators.embed import HashedBagOfWords, embed
from ..operators.rank import top_k
from ..plans.evaluate import RetrievalTask, evaluate, pair_retriever, score_run
from ..operators.fusion import jaccard_scorer
from ..operators.score import search
from ..session import SCORE_DECIMALS, cut_lineage, read_table, scratch_path
from ..sources import files, packages
from ..sources.families import mem_candidates, mem_qrels, mem_turns, txt_qrels, txt_tables, vec_family
from ..sources.task_files import load_task

DIM = 64
KS = (1, 3, 10)


def qualified(spark: SparkSession, path: str) -> str:
    """Path with the scheme of the file system that Spark uses for it, in a form that tasks can open."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _hashed():
    return HashedBagOfWords(DIM)


# ---------------------------------------------------------------- S1-S4, P1, P4
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark as queries JSONL, documents as corpus JSONL per language
    (title = source), MEM qrels as quoted and as strict TSV; one row per row read."""
    root = scratch_path(spark, "files")
    docs = read_table(spark, sf_dir, "documents")
    read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text").write.json(f"{root}/queries.jsonl")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", "lang")
    corpus.write.partitionBy("lang").json(f"{root}/corpus")
    qrels = mem_qrels(mem_turns(spark, sf_dir))
    plain = qrels.select("qid", "did", F.col("rel").cast("string").alias("rel"))
    plain.write.option("sep", "\t").option("quoteAll", "true").csv(f"{root}/quoted.tsv")
    plain.select(F.concat_ws("\t", "qid", "did", "rel").alias("value")).write.text(f"{root}/strict.tsv")
    parts = [files.read_queries_jsonl(spark, f"{root}/queries.jsonl").select(F.lit("query").alias("kind"), F.lit("").alias("subset"), F.col("qid").alias("id"), F.md5("text").alias("value"))]
    read = files.read_subsets(spark, files.read_corpus_jsonl, f"{root}/corpus", [f"lang={x}" for x in langs], "", splits=("test",))
    read = files.select_values(read, "subset", [f"lang={x}" for x in langs if x != "en"])
    parts.append(read.select(F.lit("corpus").alias("kind"), "subset", F.col("did").alias("id"), F.md5("text").alias("value")))
    for kind, df in (("quoted", files.read_qrels_tsv(spark, f"{root}/quoted.tsv")), ("strict", files.read_qrels_tsv_strict(spark, f"{root}/strict.tsv"))):
        parts.append(df.select(F.lit(kind).alias("kind"), F.lit("").alias("subset"), F.concat_ws(">", "qid", "did").alias("id"), F.col("rel").cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MEM candidate lists as JSONL and as one JSON array, read back long."""
    root = scratch_path(spark, "candidates")
    lists = mem_candidates(mem_turns(spark, sf_dir)).groupBy("qid").agg(F.collect_list("did").alias("dids"))
    lists.select(F.col("qid").alias("query_id"), F.col("dids").alias("candidate_doc_ids")).write.json(f"{root}/lists.jsonl")
    # one JSON array is one document, and one task, by the format
    objects = lists.select(F.struct(F.col("qid").alias("question_id"), F.col("dids").alias("haystack_session_ids")).alias("o"))
    objects.agg(F.to_json(F.collect_list("o")).alias("value")).write.text(f"{root}/lists.json")
    a = files.read_candidates_jsonl(spark, f"{root}/lists.jsonl").withColumn("kind", F.lit("lines"))
    b = files.read_candidates_json_array(spark, f"{root}/lists.json").withColumn("kind", F.lit("array"))
    return a.unionByName(b).select("kind", "qid", "did")


# ---------------------------------------------------------------- S9, S10, J6
def write_tars(df: DataFrame, folder: str, count: int) -> dict[str, str]:
    """(path, content) rows as ``count`` tars of a shared folder, one task each; {package: tar path}.

    A task writes under a name of its own and returns it, so only tars of
    attempts that Spark accepted are used.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = packages.open_uri(folder)
        fs.create_dir(base, recursive=True)
        name, rows = uuid.uuid4().hex, 0
        with fs.open_output_stream(f"{base}/{name}.tar") as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for pdf in pdfs:
                for path, content in zip(pdf["path"], pdf["content"]):
                    info = tarfile.TarInfo(path)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                    rows += 1
        yield pd.DataFrame({"uri": [f"{folder}/{name}.tar"], "rows": [rows]})

    made = cut_lineage(df.select("path", "content").repartition(count, "path").mapInPandas(run, "uri string, rows long"))
    uris = sorted(r["uri"] for r in made.where("rows > 0").collect())  # one row per tar
    return {f"pk{i}": uri for i, uri in enumerate(uris)}


def packages_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The html of all pages as members of tars (one of them indexed), fetched by reference."""
    folder = qualified(spark, scratch_path(spark, "packages"))
    pages = read_table(spark, sf_dir, "pages")
    rows = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    tars = write_tars(rows, folder, 4)
    members = packages.read_members(spark, tars)
    first = next(iter(tars))
    packages.write_index(members, first, tars[first])
    members = cut_lineage(packages.read_members(spark, tars))  # now the index of the first, headers of the others
    refs = pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    named = refs.join(members.select("path", "package"), "path")
    # references into the first package leave its name out
    named = packages.resolve_refs(named.withColumn("package", F.when(F.col("package") != first, F.col("package"))), first)
    got = packages.fetch(named.select("page_id", "path", "package"), members, tars)
    return got.select("page_id", F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("content_md5"))


# ---------------------------------------------------------------- lifecycle
def _mem_inputs(spark: SparkSession, sf_dir: str):
    turns = mem_turns(spark, sf_dir)
    corpus = turns.select("id", F.col("text").alias("data"))
    queries = turns.where("role = 'user'").select("id", F.col("text").alias("data"))
    return turns, queries, corpus, mem_qrels(turns)


def _later(turns: DataFrame) -> DataFrame:
    """Lists of the later turns of the conversation; a query that has none keeps an empty list."""
    pos = turns.select(F.col("id").alias("did"), F.col("turn").alias("d_turn"))
    mine = turns.where("role = 'user'").select(F.col("id").alias("qid"), F.col("turn").alias("q_turn"))
    later = mem_candidates(turns).join(pos, "did").join(mine, "qid").where("d_turn > q_turn").select("qid", "did")
    return mine.select("qid").join(later, "qid", "left").select("qid", "did")


def lifecycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM with candidate lists (later turns; empty ones count with zeros), through
    the whole lifecycle, strict with an embedder and with a pair scorer."""
    turns, queries, corpus, qrels = _mem_inputs(spark, sf_dir)
    out = scratch_path(spark, "lifecycle")
    lists = _later(turns)
    task = RetrievalTask(name="MEM", k_values=KS)
    dense = evaluate(spark, task, "hashed", _hashed, queries, corpus, qrels, out, candidates=lists, strict_candidates=True)
    pairs = evaluate(spark, task, "overlap", None, queries, corpus, qrels, out, candidates=lists, retriever=pair_retriever(jaccard_scorer))
    both = dense.withColumn("model", F.lit("hashed")).unionByName(pairs.withColumn("model", F.lit("overlap")))
    return both.where(~F.col("metric").startswith("nauc_")).select("model", "metric", "k", "value")


def lifecycle_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT by language; first one language is evaluated, then all: the stored one is kept
    as it is, the others are added.  A marker row says what the second run found stored."""
    bench, docs = txt_tables(spark, sf_dir)
    corpus = docs.select("subset", F.col("did").alias("id"), F.col("text").alias("data"))
    langs = F.array(*[F.lit(r["subset"]) for r in docs.select("subset").distinct().orderBy("subset").collect()])
    queries = bench.select(F.explode(langs).alias("subset"), F.col("qid").alias("id"), F.col("text").alias("data"))
    qrels = txt_qrels(bench, docs).join(docs.select("did", "subset"), "did").select("subset", "qid", "did", "rel")
    task, out = RetrievalTask(name="TXT", k_values=KS), scratch_path(spark, "lifecycle")
    first = evaluate(spark, task, "hashed", _hashed, queries, corpus, qrels, out, by_subset=True, subsets=["en"])
    before = first.select(F.lit("first").alias("run"), "subset", "metric", "k", "value")
    cut = cut_lineage(before)
    both = evaluate(spark, task, "hashed", _hashed, queries, corpus, qrels, out, by_subset=True)
    rows = cut.unionByName(both.select(F.lit("both").alias("run"), "subset", "metric", "k", "value"))
    return rows.where(~F.col("metric").startswith("nauc_"))


# ---------------------------------------------------------------- task configurations
def _write_config(spark: SparkSession, path: str, config: dict) -> str:
    """A task configuration as a one-line text file in the shared folder; returns its content read back."""
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def task_from_config_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark and documents as a text task on disk (queries with prompts as rows, corpus
    with a ``text`` column, JSON labels), loaded from its configuration and evaluated."""
    root = scratch_path(spark, "task-text")
    bench, docs = txt_tables(spark, sf_dir)
    bench.select(F.col("qid").alias("id"), F.col("text").alias("data"), F.lit("find: ").alias("prompt")).write.json(f"{root}/query.jsonl")
    docs.select(F.col("did").alias("id"), "text").write.parquet(f"{root}/corpus.parquet")
    files.qrels_to_json_rows(txt_qrels(bench, docs)).write.json(f"{root}/label.jsonl")
    config = {
        "name": "TXT", "k_values": list(KS), "main_metric": "ndcg_at_10",
        "data": {
            "query": {"path": "json", "modal": "TEXT", "with_prompt": True, "load_kwargs": {"data_files": f"{root}/query.jsonl"}},
            "collection": {"path": f"{root}/corpus.parquet", "modal": "TEXT", "xjx_style": True},
            "label": {"path": f"{root}/label.jsonl", "modal": "LABEL"},
        },
    }
    task = RetrievalTask.from_dict(json.loads(_write_config(spark, f"{root}/task", config)))
    data = load_task(spark, task)
    got = evaluate(spark, task, "hashed", _hashed, data.queries, data.corpus, data.qrels, f"{root}/out")
    return got.where(~F.col("metric").startswith("nauc_")).select("metric", "k", "value")


class _Media:
    """Example multimodal embedder: hashed words of the text, and the image's length in a bucket of its own."""

    def __init__(self, scale: float):
        self.words, self.scale = HashedBagOfWords(DIM), scale

    def __call__(self, inputs: pd.DataFrame) -> np.ndarray:
        words = self.words(inputs[["data"]])
        size = [0.0 if b is None else len(b) / self.scale for b in inputs["image"]]
        return np.hstack([words, np.array(size, dtype=np.float64).reshape(-1, 1)])


def task_from_config_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MIXED task on disk.  Queries are turns (TEXT), the corpus has
    sequences of a turn's text and an image (SEQ), images (IMAGE) and texts (TEXT); images are in
    tars; labels are a strict TSV.  Loaded from its configuration and embedded per modality."""
    root = scratch_path(spark, "task-mixed")
    turns = mem_turns(spark, sf_dir)
    kind = F.pmod(F.col("turn"), F.lit(3))
    image = F.struct(F.concat("id", F.lit(".png")).alias("path"))
    modal = F.when(kind == 0, "TEXT").when(kind == 1, "SEQ").otherwise("IMAGE")
    body = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("["), F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9), F.lit(","), F.to_json(image), F.lit("]"))).otherwise(F.to_json(image))
    media = turns.where(kind != 0).select(F.concat("id", F.lit(".png")).alias("path"), F.encode(F.col("text"), "UTF-8").alias("content"))
    tars = write_tars(media, qualified(spark, f"{root}/tars"), 1)
    turns.where("role = 'user'").select("id", F.col("text").alias("data"), F.lit("TEXT").alias("modal")).write.json(f"{root}/query.jsonl")
    turns.select("id", body.alias("data"), modal.alias("modal")).write.json(f"{root}/corpus.jsonl")
    mem_qrels(turns).select(F.concat_ws("\t", "qid", "did", F.col("rel").cast("string")).alias("value")).write.text(f"{root}/qrels.tsv")
    side = {"path": "json", "modal": "MIXED"}
    config = {
        "name": "MIX", "k_values": list(KS),
        "data": {
            "query": side | {"load_kwargs": {"data_files": f"{root}/query.jsonl"}}, "collection": side | {"load_kwargs": {"data_files": f"{root}/corpus.jsonl"}},
            "label": {"path": f"{root}/qrels.tsv", "modal": "LABEL", "xjx_style": True}, "packages": {k: {"path": v} for k, v in tars.items()},
        },
    }
    task = RetrievalTask.from_dict(json.loads(_write_config(spark, f"{root}/task", config)))
    data = load_task(spark, task)

    def factory():
        return _Media(100.0)

    embedders = {m: factory for m in ("TEXT", "IMAGE", "SEQ")}
    got = evaluate(spark, task, "media", embedders, data.queries, data.corpus, data.qrels, f"{root}/out", input_cols=("data", "image"))
    return got.where(~F.col("metric").startswith("nauc_")).select("metric", "k", "value")


def lenient_search(q: DataFrame, c: DataFrame, depth: int, candidates: DataFrame) -> DataFrame:
    """Dot-product hits within ``conv_id``: of the listed pairs for queries with a list, of all turns for the others."""
    with_list = candidates.select("qid").distinct()
    place = q.select("qid", "conv_id").join(candidates.where("did is not null").select("qid", "did").distinct(), "qid")
    inside = place.join(c.select("did", "conv_id"), ["did", "conv_id"], "left_semi").select("qid", "did")
    listed = candidate_pairs(inside, q, c, do_norm=False)
    free = search(q.join(with_list, "qid", "left_anti"), c, depth, do_norm=False, group_cols=["conv_id"])
    return top_k(listed.select("qid", "did", "score").unionByName(free.select("qid", "did", "score")), depth)


def custom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own search in the lifecycle: MEM by dot products at full conversation depth with the
    lenient filter to lists that only some queries have.  Listed pairs are scored directly, so no depth cuts them."""
    turns, queries, corpus, qrels = _mem_inputs(spark, sf_dir)
    conv = turns.select("id", "conv_id")
    listed = _later(turns).join(turns.where("turn > 0").select(F.col("id").alias("qid")), "qid", "left_semi")

    def retrieve(q, c, depth, candidates, keys):
        q = embed(q, _hashed).join(conv, "id").withColumnRenamed("id", "qid")
        c = embed(c, _hashed).join(conv, "id").withColumnRenamed("id", "did")
        return lenient_search(q, c, depth, candidates)

    task = RetrievalTask(name="MEM", k_values=KS, ignore_identical_ids=True)
    got = evaluate(spark, task, "dot", None, queries, corpus, qrels, scratch_path(spark, "custom"), candidates=listed, retriever=retrieve)
    return got.where(~F.col("metric").startswith("nauc_")).select("metric", "k", F.round("value", SCORE_DECIMALS).alias("value"))


def lifecycle_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM with the conversations of odd id as subset ``odd`` and the others without one (null); only
    the odd ones have documents.  Twice: the second time nothing is embedded, also not for the subset without hits."""
    turns, queries, corpus, qrels = _mem_inputs(spark, sf_dir)
    odd = turns.select("id", F.when(F.col("conv_id") % 2 == 1, "odd").alias("subset"))
    corpus = corpus.join(odd.where("subset is not null"), "id")
    qrels = qrels.join(odd.withColumnRenamed("id", "qid"), "qid").select("subset", "qid", "did", "rel")
    task, out = RetrievalTask(name="MEM", k_values=KS), scratch_path(spark, "lifecycle")

    def again(*_):
        raise AssertionError("what is stored is not searched again")

    first = evaluate(spark, task, "hashed", _hashed, queries.join(odd, "id"), corpus, qrels, out, by_subset=True)
    rows = cut_lineage(first.select(F.lit("first").alias("run"), "subset", "metric", "k", "value"))
    both = evaluate(spark, task, "hashed", again, queries.join(odd, "id"), corpus, qrels, out, by_subset=True)
    rows = rows.unionByName(both.select(F.lit("again").alias("run"), "subset", "metric", "k", "value"))
    return rows.where(~F.col("metric").startswith("nauc_"))


def class_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC by class judgments, divided by the judged queries, with a task hook that sees the grades of hits."""
    fam = vec_family(spark, sf_dir)
    run = cut_lineage(search(fam.queries, fam.corpus, KS[-1], exclude_identical=True))

    def mean_grade(hits: DataFrame) -> DataFrame:
        graded = [F.struct(F.lit(k).alias("k"), F.when(F.col("rk") <= k, F.col("rel")).otherwise(0).alias("rel")) for k in KS]
        per = hits.select("qid", F.inline(F.array(*graded))).groupBy("qid", "k").agg((F.sum("rel") / F.col("k")).alias("v"))
        return per.groupBy("k").agg(F.avg("v").alias("value")).select(F.lit("mean_grade").alias("metric"), "k", "value")

    task = RetrievalTask(name="VEC", k_values=KS)
    return score_run(run, fam.qrels, task, with_nauc=False, hook=mean_grade, denominator="qrels")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM without candidate lists: a dense search finds 20 turns per query, a pair scorer orders them."""
    turns, queries, corpus, qrels = _mem_inputs(spark, sf_dir)

    def dense(q, c, depth, candidates, keys):
        q = embed(q, _hashed).withColumnRenamed("id", "qid")
        return search(q, embed(c, _hashed).withColumnRenamed("id", "did"), depth)

    task = RetrievalTask(name="MEM", k_values=KS)
    got = evaluate(spark, task, "rerank", None, queries, corpus, qrels, scratch_path(spark, "rerank"), retriever=pair_retriever(jaccard_scorer, dense, 20))
    return got.where(~F.col("metric").startswith("nauc_")).select("metric", "k", "value")


REGISTRY = {
    "lifecycle_empty": lifecycle_empty,
    "class_judgments": class_judgments,
    "rerank": rerank,
    "files_round_trip": files_round_trip,
    "candidates_round_trip": candidates_round_trip,
    "packages_fetch": packages_fetch,
    "lifecycle_candidates": lifecycle_candidates,
    "lifecycle_resume": lifecycle_resume,
    "task_from_config_text": task_from_config_text,
    "task_from_config_mixed": task_from_config_mixed,
    "custom_search": custom_search,
}
