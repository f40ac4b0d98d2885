"""Retrieval task families derived from the driver's test tables.

Each builder reads whole tables and returns the inputs a retrieval task
needs - queries, corpus, qrels and (for MEM) candidate lists - as DataFrames
in the engine's long format.  They only shape input rows; every retrieval
and metric step runs in the operators.

* VEC: every embedding is a query against all embeddings (identical id
  excluded).  A document with the query's label is relevant, with grade 2 if its
  id is a multiple of 3, else 1; one with the next label (label + 1 mod 10) is
  judged 0.  The judgments are by class (``ClassQrels``): a document's class is
  its label and whether its id is a multiple of 3, so nothing of the size
  label x label is built.
* TXT: ``benchmark`` passages are queries, ``documents`` the corpus
  (subset = language; the corpus keeps ids, subset and vectors only); a document is relevant (1) when it contains the
  passage verbatim (Aho-Corasick containment join).  Vectors: hashed bag of
  words.
* MEM: user turns are queries, all turns the corpus (ids ``conv-turn``); the
  judged document is the next turn: 1 when it is an assistant turn, else 0.
  Candidates are all turns of the same conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contains import contains_pairs
from ..operators.embed import hashed_embedding
from ..operators.metrics import ClassQrels
from ..session import cut_lineage, read_table

# Fixed parameters of the derived families.
TEXT_DIM = 64
N_LABELS = 10


class Family:
    """Inputs of one task: ``queries`` (qid, vec, ...), ``corpus`` (did, vec, ...),
    ``qrels`` (qid, did, rel) and optional ``candidates`` (qid, did).

    Attributes may be given as zero-argument builders; each is built on first
    use only, so a query that needs just the qrels never embeds any text.
    """

    def __init__(self, queries, corpus, qrels, candidates=None):
        self._parts = {"queries": queries, "corpus": corpus, "qrels": qrels, "candidates": candidates}

    def __getattr__(self, name):
        parts = self.__dict__.get("_parts", {})
        if name not in parts:
            raise AttributeError(name)
        v = parts[name]
        if callable(v):
            v = parts[name] = v()
        return v


def _once(build):
    """A zero-argument builder that runs ``build`` on its first call only."""
    box = []

    def get():
        if not box:
            box.append(build())
        return box[0]

    return get


def vec_class(label: str = "label", vec_id: str = "vec_id"):
    """Class of a document: its label, and whether its id is a multiple of 3."""
    return F.concat(F.col(label).cast("string"), F.when(F.pmod(F.col(vec_id), F.lit(3)) == 0, ":3").otherwise(":"))


def vec_rules(emb: DataFrame) -> DataFrame:
    """Grades of (query label, document class): one row per judged pair of classes."""
    doc = emb.where("label is not null").select("label", vec_class().alias("dclass")).distinct()
    before = F.pmod(F.col("label") - 1, F.lit(N_LABELS))
    same = F.struct(F.col("label").cast("string").alias("qclass"), "dclass", F.when(F.col("dclass").endswith(":3"), 2).otherwise(1).alias("rel"))
    zero = F.struct(before.cast("string").alias("qclass"), "dclass", F.lit(0).alias("rel"))
    return doc.select(F.inline(F.array(same, zero)))


def vec_family(spark: SparkSession, sf_dir: str) -> Family:
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    queries = emb.select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vec"))
    corpus = emb.select(F.col("vec_id").cast("string").alias("did"), F.col("embedding").alias("vec"), "label")

    def qrels():
        q = emb.select(F.col("vec_id").cast("string").alias("qid"), F.col("label").cast("string").alias("qclass"))
        d = emb.select(F.col("vec_id").cast("string").alias("did"), vec_class().alias("dclass"))
        return ClassQrels(q, d, vec_rules(emb.select("label", "vec_id")))

    return Family(queries, corpus, qrels)


def txt_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw text sides of TXT: (qid, text) and (did, text, subset)."""
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("did"), "text", F.col("lang").alias("subset")
    )
    return bench, docs


def txt_qrels(bench: DataFrame, docs: DataFrame) -> DataFrame:
    """The containment join runs once; metrics read its result several times."""
    found = contains_pairs(docs, bench, did="did", doc_text="text", pid="qid", passage_text="text")
    return cut_lineage(found.select(F.col("pid").alias("qid"), "did", F.lit(1).alias("rel")))


def txt_family(spark: SparkSession, sf_dir: str, dim: int = TEXT_DIM) -> Family:
    bench, docs = txt_tables(spark, sf_dir)
    # embeddings are computed once and kept (checkpoint) for every later use
    return Family(lambda: cut_lineage(hashed_embedding(bench, "text", dim)),
                  lambda: cut_lineage(hashed_embedding(docs, "text", dim).drop("text")), lambda: txt_qrels(bench, docs))


def mem_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(
        "conv_id", "turn", "role", "text",
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
    )


def mem_qrels(turns: DataFrame) -> DataFrame:
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("id").alias("qid"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("did"), "role")
    return user.join(nxt, ["conv_id", "turn"]).select(
        "qid", "did", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("rel")
    )


def mem_candidates(turns: DataFrame) -> DataFrame:
    """``(qid, did)``: all turns of the query's conversation, which is what the lists hold."""
    user = turns.where(F.col("role") == "user").select("conv_id", F.col("id").alias("qid"))
    return user.join(turns.select("conv_id", F.col("id").alias("did")), "conv_id").select("qid", "did")


def mem_family(spark: SparkSession, sf_dir: str, dim: int = TEXT_DIM) -> Family:
    turns = mem_turns(spark, sf_dir)
    vecs = _once(lambda: cut_lineage(hashed_embedding(turns, "text", dim)))

    def queries():
        return vecs().where(F.col("role") == "user").select(F.col("id").alias("qid"), "vec", "text", "conv_id")

    def corpus():
        return vecs().select(F.col("id").alias("did"), "vec", "text", "conv_id")

    return Family(queries, corpus, mem_qrels(turns), mem_candidates(turns))
