"""Input preparation: modality routing, sequences, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sequence_first_image, sequence_text

IMAGE_REF = "struct<path:string,package:string>"
SEQ_ITEM = "struct<text:string,path:string,package:string>"


def by_modality(df: DataFrame, modal: str, modal_col: str = "modal") -> DataFrame:
    """P5: rows of one modality (TEXT, IMAGE or SEQ)."""
    return df.where(F.col(modal_col) == F.lit(modal))


def modality_groups(df: DataFrame, order: Sequence[str] = ("TEXT", "IMAGE", "SEQ"),
                    modal_col: str = "modal") -> DataFrame:
    """The modality groups concatenated in a fixed order (``grp`` = position)."""
    parts = [by_modality(df, m, modal_col).withColumn("grp", F.lit(i)) for i, m in enumerate(order)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _checked_ref(raw: F.Column, parsed: F.Column, where: F.Column) -> F.Column:
    """A parsed image reference; one without a path, or that is no JSON object, fails the job and shows its text."""
    bad = parsed["path"].isNull()
    message = F.concat(where, F.lit(": no image path in "), F.substr(raw, F.lit(1), F.lit(200)))
    return F.when(raw.isNull(), F.lit(None).cast(IMAGE_REF)).when(bad, F.raise_error(message).cast(IMAGE_REF)).otherwise(parsed)


def parse_image_ref(data: str = "data") -> F.Column:
    """IMAGE rows carry ``{"path": ..., "package": ...}`` as JSON text.

    Null stays null.  Text that is no such object, or has no path, fails the job.
    """
    return _checked_ref(F.col(data), F.from_json(F.col(data), IMAGE_REF), F.lit("IMAGE row"))


def sequence_elements(data: str = "data") -> F.Column:
    """Elements of a SEQ row as ``array<struct<position, kind, raw>>`` without failing: ``kind`` is ``text``, ``image``,
    ``null`` (a JSON null), ``error`` (a nested array, an object without a path), and one ``error`` at position -1 with
    the whole text for a row that is no JSON array."""
    text = F.col(data)
    # as the member of an object, so that text behind the array is malformed, too
    raw = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x array<string>")["x"]
    # a string element loses its quotes: what a variant says it is decides, not how it begins
    parsed = F.try_parse_json(text)
    is_array = raw.isNotNull() & F.schema_of_variant(parsed).startswith("ARRAY<")
    kinds = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda e, i: F.struct(
        i.alias("position"), F.schema_of_variant(F.try_variant_get(parsed, F.lit("$"), "array<variant>")[i]).alias("type"), e.alias("raw")))
    has_path = lambda e: F.from_json(e["raw"], IMAGE_REF)["path"].isNotNull()
    kind = lambda e: (
        F.when(e["type"].startswith("OBJECT<"), F.when(has_path(e), "image").otherwise("error"))
        .when(e["type"].startswith("ARRAY<"), "error").when(e["raw"].isNull(), "null").otherwise("text"))
    elements = F.transform(kinds, lambda e: F.struct(e["position"].cast("int").alias("position"), kind(e).alias("kind"), e["raw"].alias("raw")))
    whole = F.array(F.struct(F.lit(-1).alias("position"), F.lit("error").alias("kind"), text.alias("raw")))
    return F.when(text.isNull(), F.lit(None)).when(F.coalesce(is_array, F.lit(False)), elements).otherwise(whole)


def sequence_errors(df: DataFrame, id_col: str = "id", data: str = "data") -> DataFrame:
    """``(id, position, raw)`` of every element of SEQ rows that cannot be read (position -1: the whole row)."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(sequence_elements(data)).alias("e")).where(F.col("e.kind") == "error")
    return rows.select("id", "e.position", "e.raw")


def parse_sequence(data: str = "data") -> F.Column:
    """SEQ rows carry a JSON array mixing strings and image objects.

    A JSON object is an image reference, any other scalar is text, a JSON null is
    neither (it adds nothing).  Text that is no JSON array, a nested array and an
    object without a path fail the job; ``sequence_errors`` lists them instead.
    """
    none = F.lit(None).cast("string")

    def item(e: F.Column) -> F.Column:
        ref = F.from_json(e["raw"], IMAGE_REF)
        message = F.concat(F.lit("SEQ row, element "), e["position"].cast("string"), F.lit(" cannot be read: "), F.substr(F.coalesce(e["raw"], F.lit("null")), F.lit(1), F.lit(200)))
        return (
            F.when(e["kind"] == "image", F.struct(none.alias("text"), ref["path"].alias("path"), ref["package"].alias("package")))
            .when(e["kind"] == "error", F.raise_error(message).cast(SEQ_ITEM))
            .otherwise(F.struct(F.when(e["kind"] == "text", e["raw"]).alias("text"), none.alias("path"), none.alias("package"))))

    return F.transform(sequence_elements(data), item)


def flatten_sequences(df: DataFrame, items: str = "items") -> DataFrame:
    """``seq_text`` (text parts each followed by a space) and ``seq_image`` (first image)."""
    return df.withColumn("seq_text", sequence_text(items)).withColumn("seq_image", sequence_first_image(items))


PROMPT_PRIORITY = ("task_side", "task", "type_side", "type", "side")
_SEP = "\u001f"


def resolve_prompts(rows: DataFrame, prompts, task: str = "task", type_: str = "task_type",
                    side: str = "side") -> DataFrame:
    """Prompt per row by priority task+side, task, type+side, type, side.

    ``prompts`` is the prompt configuration: ``(scope, key, side, prompt)``
    tuples, ``scope`` naming the level, ``key`` the task name or type (None for
    scope ``side``), ``side`` the input side (None for scopes without side).
    The configuration becomes literal maps, so resolution is a per-row map
    lookup with no join.  Adds ``prompt`` (null when no level applies).
    """
    keys = {
        "task_side": lambda k, s: f"{k}{_SEP}{s}",
        "task": lambda k, s: k,
        "type_side": lambda k, s: f"{k}{_SEP}{s}",
        "type": lambda k, s: k,
        "side": lambda k, s: s,
    }
    row_key = {
        "task_side": F.concat_ws(_SEP, F.col(task), F.col(side)),
        "task": F.col(task),
        "type_side": F.concat_ws(_SEP, F.col(type_), F.col(side)),
        "type": F.col(type_),
        "side": F.col(side),
    }
    picks = []
    for scope in PROMPT_PRIORITY:
        entries = {}
        for sc, k, sd, prompt in prompts:
            if sc == scope:
                entries[keys[scope](k, sd)] = prompt
        if entries:
            lut = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
            picks.append(F.try_element_at(lut, row_key[scope]))
    prompt_col = F.coalesce(*picks) if picks else F.lit(None)
    return rows.withColumn("prompt", prompt_col.cast("string"))


def with_prompt_text(df: DataFrame, text: str = "text", prompt: str = "prompt", out: str = "input") -> DataFrame:
    """Model input = prompt + text (no prompt -> text)."""
    return df.withColumn(out, F.concat(F.coalesce(F.col(prompt), F.lit("")), F.col(text)))
