"""File sources: queries / corpus / qrels / candidate lists.

All readers take explicit schemas (no inference), keep ids as strings and
resolve "last row wins" duplicates with a partial aggregate (``max_by`` on
the file position), so a hot id never pins a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import compose_text, strip_ws
from .json_array import read_json_array

_ARRAY_STR = ArrayType(StringType())


def file_position() -> Column:
    """Row position in input order: (file, split start, row id inside the split)."""
    return F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r"),
    )


def last_wins(df: DataFrame, keys: Sequence[str], pos: str = "_pos") -> DataFrame:
    """Keep the last row (largest ``pos``) per key, as a dict build would."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys and c != pos]
    if not others:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(pos)).alias("_row"))
    return best.select(*keys, "_row.*")


def _string_schema(fields: Sequence[str]) -> StructType:
    return StructType([StructField(f, StringType()) for f in dict.fromkeys(fields)])


def _required(c: Column, what: str) -> Column:
    """The column, failing the job when it is null (a ``d[field]`` lookup)."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"missing required field {what}"))).otherwise(c)


def read_queries_jsonl(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text") -> DataFrame:
    """S1 queries: ``(qid, text)``; both fields are required, last duplicate wins."""
    raw = spark.read.schema(_string_schema([id_field, text_field])).option("mode", "FAILFAST").json(path)
    df = raw.select(
        _required(F.col(id_field), id_field).alias("qid"),
        _required(F.col(text_field), text_field).alias("text"),
        file_position().alias("_pos"),
    )
    return last_wins(df, ["qid"])


def read_corpus_jsonl(
    spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", title_field: str = "title"
) -> DataFrame:
    """S1 corpus + P1 + P2: ``(did, text)`` with text = title + " " + text (nulls as "")."""
    raw = spark.read.schema(_string_schema([id_field, text_field, title_field])).option("mode", "FAILFAST").json(path)
    df = raw.select(
        _required(F.col(id_field), id_field).alias("did"),
        compose_text(F.col(title_field), F.col(text_field)).alias("text"),
        file_position().alias("_pos"),
    )
    return last_wins(df, ["did"])


def read_subsets(
    spark: SparkSession,
    reader,
    root: str,
    subsets: Sequence[str],
    file_name: str,
    splits: Sequence[str] = ("test",),
    **kw,
) -> DataFrame:
    """``root/<subset>/<file>`` per subset (subset may be "" or contain "/"),
    tagged with ``subset`` and fanned out to every split (all splits share the file)."""
    parts = []
    for s in subsets:
        path = "/".join(p for p in (root.rstrip("/"), s.strip("/"), file_name) if p)
        parts.append(reader(spark, path, **kw).withColumn("subset", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("split", F.explode(F.array(*[F.lit(x) for x in splits])))


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless ``qid<TAB>did<TAB>score`` with CSV quoting; a non-integer score fails."""
    raw = (
        spark.read.schema(_string_schema(["qid", "did", "rel"]))
        .option("sep", "\t").option("quote", '"').option("escape", '"').option("header", "false")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    df = raw.select("qid", "did", F.col("rel").cast("int").alias("rel"), file_position().alias("_pos"))
    return last_wins(df, ["qid", "did"])


def read_qrels_tsv_strict(spark: SparkSession, path: str) -> DataFrame:
    """No quoting, each stripped line must have exactly 3 tab-separated fields."""
    lines = spark.read.text(path).select(strip_ws("value").alias("line"), file_position().alias("_pos"))
    parts = lines.select(F.split("line", "\t").alias("p"), "_pos")
    checked = parts.select(
        F.when(F.size("p") != 3, F.raise_error(F.concat(F.lit("expected 3 fields: "), F.array_join("p", "\\t"))))
        .otherwise(F.col("p")).alias("p"),
        "_pos",
    )
    df = checked.select(
        F.get("p", 0).alias("qid"), F.get("p", 1).alias("did"), F.get("p", 2).cast("int").alias("rel"), "_pos"
    )
    return last_wins(df, ["qid", "did"])


def qrels_from_json_rows(rows: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """``(id, data = JSON {did: int})`` rows -> long ``(qid, did, rel)``.

    Malformed JSON and rows without id or data fail the job; of several rows
    with one id the last one read wins, as in a dict.
    """
    m = F.from_json(_required(F.col(data_col), data_col), "map<string,int>", {"mode": "FAILFAST"})
    parsed = rows.select(_required(F.col(id_col), id_col).cast("string").alias("qid"), m.alias("judged"), F.monotonically_increasing_id().alias("_pos"))
    # a map cannot be grouped by, but the last row of an id can be picked with it inside a struct
    last = parsed.groupBy("qid").agg(F.max_by(F.struct("judged"), "_pos").alias("row"))
    return last.select("qid", F.explode("row.judged").alias("did", "rel"))


def qrels_to_json_rows(qrels: DataFrame) -> DataFrame:
    """Long qrels -> ``(id, data)`` with the judgments as a JSON object (ids sorted)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("did").cast("string").alias("did"), F.col("rel"))))
    return qrels.groupBy(F.col("qid").cast("string").alias("id")).agg(
        F.to_json(F.map_from_entries(entries)).alias("data")
    )


def read_dataset(spark: SparkSession, path: str, modal: str, with_prompt: bool = False, fmt: str = "json") -> DataFrame:
    """Fixed-schema rows ``id, data[, prompt][, modal]`` (all strings)."""
    fields = ["id", "data"] + (["prompt"] if with_prompt else []) + (["modal"] if modal == "MIXED" else [])
    reader = spark.read.format(fmt).schema(_string_schema(fields))
    raw = (reader.option("mode", "FAILFAST") if fmt == "json" else reader).load(path)
    return raw.withColumn("id", _required(F.col("id"), "id"))


def rename_text_to_data(df: DataFrame) -> DataFrame:
    """TEXT sets name their payload ``data``; P2: ``_id`` is dropped."""
    return df.drop("_id").withColumnRenamed("text", "data")


def read_candidates_jsonl(spark: SparkSession, path: str, qid_field: str = "query_id",
                          list_field: str = "candidate_doc_ids") -> DataFrame:
    """``{query_id, candidate_doc_ids[]}`` lines -> ``(qid, did)``; an empty list keeps
    the query with a null did; the last line of a query wins."""
    schema = StructType([StructField(qid_field, StringType()), StructField(list_field, _ARRAY_STR)])
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(
        _required(F.col(qid_field), qid_field).alias("qid"), F.col(list_field).alias("dids"), file_position().alias("_pos")
    )
    lists = last_wins(raw, ["qid"])
    return lists.select("qid", F.explode_outer("dids").alias("did"))


def read_candidates_json_array(spark: SparkSession, path: str, qid_field: str = "question_id",
                               list_field: str = "haystack_session_ids") -> DataFrame:
    """One JSON array of ``{question_id, haystack_session_ids[]}`` objects, read by several tasks if it is large."""
    schema = StructType([StructField(qid_field, StringType()), StructField(list_field, _ARRAY_STR)])
    raw = read_json_array(spark, path, schema).select(_required(F.col(qid_field), qid_field).alias("qid"), F.col(list_field).alias("dids"), "_pos")
    lists = last_wins(raw, ["qid"])
    return lists.select("qid", F.explode_outer("dids").alias("did"))


def load_counts(tables: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """P10: the ``only_load`` pass - row counts per side (and keys) without scoring."""
    out = None
    for side, df in tables.items():
        c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
        out = c if out is None else out.unionByName(c)
    return out


def select_values(df: DataFrame, col: str, values: Sequence[str] | None) -> DataFrame:
    """Keep only the requested subsets / splits / tasks (partition pruning on a
    partitioned table)."""
    return df if not values else df.where(F.col(col).isin(list(values)))

