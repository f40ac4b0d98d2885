"""Task data from a JSON task configuration (query, collection, label, packages).

Each side of ``data`` names a ``path`` and a ``modal``; ``path`` is a file or
folder, or a format name with ``load_kwargs.data_files``.  Sides have rows
``id, data[, prompt][, modal]``; ``xjx_style`` sides have a ``text`` column, and
such labels are strict TSV files.  IMAGE and SEQ rows are resolved against the
tar packages, so that embedders get text parts and image bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import flatten_sequences, parse_image_ref, parse_sequence
from ..session import cut_lineage
from . import files, packages

TEXT, IMAGE, SEQ, MIXED, LABEL = "TEXT", "IMAGE", "SEQ", "MIXED", "LABEL"
_FORMATS = {"jsonl": "json", "json": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc"}


@dataclass
class TaskData:
    """``queries``/``corpus`` ``(id, data[, prompt][, modal][, image])``, ``qrels`` ``(qid, did, rel)``."""

    queries: DataFrame
    corpus: DataFrame
    qrels: DataFrame
    packages: dict[str, str]


def _location(side: dict) -> tuple[str, list[str]]:
    """(format, paths) of a side."""
    listed = (side.get("load_kwargs") or {}).get("data_files")
    if listed is not None:
        paths = [listed] if isinstance(listed, str) else [p for x in (listed.values() if isinstance(listed, dict) else listed) for p in ([x] if isinstance(x, str) else x)]
        return _FORMATS.get(side["path"], side["path"]), paths
    kind = side["path"].rstrip("/").rpartition(".")[2].lower()
    return _FORMATS.get(kind, "json"), [side["path"]]


def read_side(spark: SparkSession, side: dict) -> DataFrame:
    """Rows of one side, all columns strings; P3 for ``xjx_style`` text, P4 for rows that repeat an id."""
    kind, paths = _location(side)
    modal, own_style = side["modal"], side.get("xjx_style", False)
    fields = ["id", "text" if own_style and modal == TEXT else "data"]
    fields += (["prompt"] if side.get("with_prompt") else []) + (["modal"] if modal == MIXED else [])
    reader = spark.read.format(kind).schema(files._string_schema(fields))
    raw = (reader.option("mode", "FAILFAST") if kind == "json" else reader).load(paths)
    rows = raw.select(files._required(F.col("id"), "id").alias("id"), *fields[1:], files.file_position().alias("_pos"))
    return files.rename_text_to_data(files.last_wins(rows, ["id"]))


def read_labels(spark: SparkSession, side: dict) -> DataFrame:
    """Qrels of the label side: strict TSV (``xjx_style``) or rows of JSON objects."""
    kind, paths = _location(side)
    if side.get("xjx_style", False):
        return files.read_qrels_tsv_strict(spark, paths)
    rows = spark.read.format(kind).schema(files._string_schema(["id", "data"]))
    return files.qrels_from_json_rows((rows.option("mode", "FAILFAST") if kind == "json" else rows).load(paths))


def resolve_media(df: DataFrame, modal: str, members: DataFrame, tars: dict[str, str]) -> DataFrame:
    """IMAGE and SEQ rows with their text in ``data`` and the bytes of their (first) image in ``image``."""
    default = next(iter(tars))
    of = F.col("modal") if modal == MIXED else F.lit(modal)
    tagged = df.withColumn("_modal", of)
    text = tagged.where(F.col("_modal") == TEXT).withColumn("_ref", F.lit(None).cast("struct<path:string,package:string>"))
    image = tagged.where(F.col("_modal") == IMAGE).withColumn("_ref", parse_image_ref("data")).withColumn("data", F.lit(""))
    seq = flatten_sequences(tagged.where(F.col("_modal") == SEQ).withColumn("_items", parse_sequence("data")), "_items")
    seq = seq.withColumn("_ref", F.struct(F.col("seq_image.path").alias("path"), F.col("seq_image.package").alias("package")))
    seq = seq.withColumn("data", F.col("seq_text")).drop("_items", "seq_text", "seq_image")
    rows = text.unionByName(image).unionByName(seq).drop("_modal")
    wanted = rows.where(F.col("_ref.path").isNotNull()).select("id", F.col("_ref.path").alias("path"), F.col("_ref.package").alias("package"))
    fetched = packages.fetch(packages.resolve_refs(wanted, default), members, tars).select(F.col("id").alias("_id"), F.col("content").alias("image"))
    return rows.drop("_ref").join(fetched, F.col("id") == F.col("_id"), "left").drop("_id")


def load_task(spark: SparkSession, task) -> TaskData:
    """The tables that a task's ``data`` block names."""
    data = task.data
    tars = {name: p["path"] for name, p in (data.get("packages") or {}).items()}
    # read once: without an index a tar is walked from header to header by one task
    members = cut_lineage(packages.read_members(spark, tars)) if tars else None
    sides = []
    for name in ("query", "collection"):
        side = data[name]
        df = read_side(spark, side)
        if side["modal"] != TEXT:
            if members is None:
                raise ValueError(f"the {name} side of {task.name} needs packages")
            df = resolve_media(df, side["modal"], members, tars)
        sides.append(df)
    return TaskData(*sides, read_labels(spark, data["label"]), tars)
