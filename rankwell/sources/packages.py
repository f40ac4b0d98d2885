"""Tar packages of media files.

A package is a tar archive plus an optional ``.index`` TSV
(``member<TAB>offset<TAB>size``, regular files only).  The member table is
read from the index files when present, otherwise built by one task per tar
that walks the headers only.  Fetching joins the wanted references with the
member table, sorts each package's reads by offset and reads byte ranges in
``mapInPandas`` - every task opens only the packages of its own rows.

Tars lie on a file system that the executors share; tasks open them by range
through ``pyarrow.fs`` (local files, HDFS, S3, GCS by their URI).  As in a dict
of members, the last of several members with one name wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import default_package

MEMBER_SCHEMA = "package string, path string, offset bigint, size bigint"
INDEX_SUFFIX = ".index"


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (a local path without scheme too)."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import tarfile

    for pdf in pdfs:
        rows = []
        for name, tar_path in zip(pdf["package"], pdf["tar_path"]):
            fs, path = open_uri(tar_path)
            with fs.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tf:
                for m in tf:
                    if m.isfile():
                        rows.append((name, m.name, m.offset_data, m.size))
        yield pd.DataFrame(rows, columns=["package", "path", "offset", "size"])


def last_members(members: DataFrame) -> DataFrame:
    """One row per (package, path): the member that comes last in its tar."""
    return members.groupBy("package", "path").agg(F.max_by("size", "offset").alias("size"), F.max("offset").alias("offset")).select(
        "package", "path", "offset", "size")


def build_members(spark: SparkSession, packages: dict[str, str]) -> DataFrame:
    """S9 build: ``{package name: tar path}`` -> members table (one task per tar, headers only)."""
    pkgs = spark.createDataFrame(list(packages.items()), "package string, tar_path string")
    return last_members(pkgs.repartition(max(1, len(packages)), "package").mapInPandas(_walk, MEMBER_SCHEMA))


def read_members(spark: SparkSession, packages: dict[str, str], index_suffix: str = INDEX_SUFFIX) -> DataFrame:
    """Members from the ``.index`` files where they exist, built from the tar otherwise."""
    indexed = {k: v for k, v in packages.items() if _exists(spark, v + index_suffix)}
    missing = {k: v for k, v in packages.items() if k not in indexed}
    parts = []
    for name, tar_path in indexed.items():
        idx = (
            spark.read.schema("path string, offset bigint, size bigint").option("sep", "\t")
            .option("mode", "FAILFAST").csv(tar_path + index_suffix)
        )
        parts.append(last_members(idx.select(F.lit(name).alias("package"), "path", "offset", "size")))
    if missing:
        parts.append(build_members(spark, missing))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_index(members: DataFrame, package: str, tar_path: str, index_suffix: str = INDEX_SUFFIX) -> None:
    """Save one package's member index as a headerless TSV next to the tar."""
    members.where(F.col("package") == package).select("path", "offset", "size").coalesce(1).write.mode(
        "overwrite"
    ).option("sep", "\t").csv(tar_path + index_suffix)


def resolve_refs(refs: DataFrame, default: str, package_col: str = "package") -> DataFrame:
    """A reference without a package uses the default (first declared) package."""
    return refs.withColumn(package_col, default_package(package_col, default))


def missing_refs(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Wanted (package, path) keys that no package holds."""
    return refs.join(members, ["package", "path"], "left_anti")


def fetch(refs: DataFrame, members: DataFrame, packages: dict[str, str], strict: bool = True) -> DataFrame:
    """``refs(package, path, ...)`` -> same rows plus ``content binary``.

    ``strict`` fails the job when a reference is missing (``KeyError`` in a
    dict lookup); otherwise missing references get a null content.
    """
    tars = refs.sparkSession.createDataFrame(list(packages.items()), "package string, tar_path string")
    joined = refs.join(last_members(members), ["package", "path"], "left")
    if strict:
        joined = joined.withColumn(
            "offset",
            F.when(F.col("offset").isNull(),
                   F.raise_error(F.concat(F.lit("member not found: "), F.col("package"), F.lit(":"), F.col("path"))))
            .otherwise(F.col("offset")),
        )
    joined = joined.join(F.broadcast(tars), "package", "left")
    # range partitions on (package, offset): reads stay sequential inside a task and
    # a package holding most of the references is still split over many tasks
    ordered = joined.repartitionByRange("package", "offset").sortWithinPartitions("package", "offset")
    cols = [c for c in refs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields) + ", content binary"

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handles: dict[str, object] = {}
        try:
            for pdf in pdfs:
                out = []
                for tar_path, off, size in zip(pdf["tar_path"], pdf["offset"], pdf["size"]):
                    if tar_path is None or pd.isna(off):
                        out.append(None)
                        continue
                    fh = handles.get(tar_path)
                    if fh is None:
                        fs, path = open_uri(tar_path)
                        fh = handles[tar_path] = fs.open_input_file(path)
                    out.append(fh.read_at(int(size), int(off)))
                res = pdf[cols].copy()
                res["content"] = out
                yield res
        finally:
            for fh in handles.values():
                fh.close()

    return ordered.select(*cols, "tar_path", "offset", "size").mapInPandas(read, schema)


def package_size(members: DataFrame) -> DataFrame:
    """``len`` per package."""
    return members.groupBy("package").agg(F.count(F.lit(1)).alias("n_members"))


def contains_keys(refs: DataFrame, members: DataFrame) -> DataFrame:
    """``key in package`` for every reference row."""
    flag = members.select("package", "path", F.lit(True).alias("present")).distinct()
    return refs.join(flag, ["package", "path"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def sequence_inputs(seq_rows: DataFrame, members: DataFrame, packages: dict[str, str], default: str,
                    id_col: str = "id", data_col: str = "data") -> DataFrame:
    """SEQ rows (JSON sequences) -> ``(id, seq_text, image)``.

    The text parts (each followed by a space) and the bytes of the first
    image, fetched from its package (default: the first declared one), are the
    inputs a multimodal embedder receives; rows without an image get null.
    """
    from ..operators.prep import flatten_sequences, parse_sequence

    flat = flatten_sequences(seq_rows.select(id_col, parse_sequence(data_col).alias("items")), "items")
    with_img = flat.where(F.col("seq_image").isNotNull()).select(
        id_col, F.col("seq_image.path").alias("path"), F.col("seq_image.package").alias("package"))
    fetched = fetch(resolve_refs(with_img, default), members, packages)
    return flat.select(id_col, "seq_text").join(
        fetched.select(id_col, F.col("content").alias("image")), id_col, "left")
