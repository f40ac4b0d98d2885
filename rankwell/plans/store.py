"""Result tables and resumability.

Embeddings, runs and metrics are Parquet tables partitioned by
``(model, task, side, part)``, ``(model, task, stage, part)`` and
``(model, task, part)``, where ``part`` names the subset, so that each subset
is written, found and replaced by itself.  Writes use dynamic partition
overwrite: writing some subsets leaves the others, and a lost executor only
costs a task retry.  Sweep planning is a ``left_anti`` join against what exists.

A ``Manifest`` says what is complete: one row per (model, task, stage, subset)
with the number of rows and a fingerprint of the inputs, written after the data.  So
an empty result counts as stored, a half-written one does not, and a result of
other inputs is not used.  Embeddings are committed in chunks with a hash of each
row's input: a run that was killed embeds only the rows that are missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import ClassQrels, PairQrels, metric_name
from ..session import cut_lineage, scratch_path

RUN_SCHEMA = "subset string, qid string, did string, score double, rk int"
EMBEDDING_SCHEMA = "subset string, id string, vec array<double>, source long"
METRICS_SCHEMA = "subset string, metric string, k int, value double"
MANIFEST_SCHEMA = "model string, task string, stage string, subset string, rows long, mark string"
#: Most commits of one embedding, however many rows.
MAX_CHUNKS = 32


def _write(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _append(df: DataFrame, root: str, columns: Sequence[str], **names: str) -> None:
    """As ``_save``, beside what is stored."""
    _tagged(df, columns, **names).write.mode("append").partitionBy(*names, "part").parquet(root)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _tagged(df: DataFrame, columns: Sequence[str], **names: str) -> DataFrame:
    """Rows of ``columns`` with their subset ("" if there is none) and the partition columns."""
    out = df.select(subset_of(df).alias("subset"), *[c for c in columns if c in df.columns])
    for k, v in names.items():
        out = out.withColumn(k, F.lit(v))
    # an empty partition value would read back as null
    return out.withColumn("part", F.concat(F.lit("s_"), F.col("subset")))


def _save(df: DataFrame, root: str, columns: Sequence[str], **names: str) -> None:
    """Replace the named partitions of the subsets in ``df``."""
    _write(_tagged(df, columns, **names), root, [*names, "part"])


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether any data file lies below a folder: an empty result leaves none."""
    if not _exists(spark, path):
        return False
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hpath, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def _subset_path(spark: SparkSession, root: str, subset: str, **names: str) -> str:
    parts = {**names, "part": f"s_{subset}"}
    return "/".join([root.rstrip("/"), *[f"{k}={_escaped(spark, v)}" for k, v in parts.items()]])


def drop_subsets(spark: SparkSession, root: str, subsets: set[str], **names: str) -> None:
    """Remove what is stored of some subsets, before they are written anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for s in sorted(subsets):
        path = jvm.org.apache.hadoop.fs.Path(_subset_path(spark, root, s, **names))
        path.getFileSystem(conf).delete(path, True)


def _load(spark: SparkSession, root: str, **names: str) -> DataFrame | None:
    path = "/".join([root.rstrip("/"), *[f"{k}={_escaped(spark, v)}" for k, v in names.items()]])
    if not _has_files(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path).drop("part")


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it into a path ("/" in model names and the like)."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def subset_of(df: DataFrame) -> F.Column:
    """A row's subset: "" if it is null or there is none."""
    return F.coalesce(F.col("subset").cast("string"), F.lit("")) if "subset" in df.columns else F.lit("")


# ---------------------------------------------------------------- manifest
def fingerprints(df: "DataFrame | PairQrels | ClassQrels | None") -> dict[str, str]:
    """Subset -> number of rows and a hash of their content, whatever the order of rows and columns.

    One aggregate over the input; tables without a ``subset`` column have the subset "".
    """
    if df is None:
        return {}
    if isinstance(df, PairQrels):
        df = df.qrels
    if isinstance(df, ClassQrels):
        parts = [fingerprints(x) for x in (df.queries, df.docs, df.rules)]
        rules = parts[2].get("", "")
        return {s: f"{parts[0].get(s, '')}/{parts[1].get(s, '')}/{rules}/{df.skip_identical}" for s in {*parts[0], *parts[1]}}
    rows = df.select(subset_of(df).alias("subset"), row_hash(df, [c for c in df.columns if c != "subset"]).cast("decimal(38,0)").alias("h"))
    got = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).collect()  # a task has a bounded list of subsets
    return {r["subset"]: f"{r['n']}:{r['h']}" for r in got}


def row_hash(df: DataFrame, columns: Sequence[str]) -> F.Column:
    """Hash of the named columns of a row, nulls told from empty texts."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def mark_of(*parts) -> str:
    """One fingerprint of several values."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:32]


class Manifest:
    """What one model's evaluation of a task has stored completely."""

    def __init__(self, spark: SparkSession, root: str, model: str, task: str):
        self.spark, self.root, self.names = spark, root, {"model": model, "task": task}

    def entries(self, stage: str) -> dict[str, tuple[int, str]]:
        """Subset -> (rows, mark) of a stage."""
        table = _load(self.spark, self.root, **self.names, stage=stage)
        return {} if table is None else {r["subset"]: (r["rows"], r["mark"]) for r in table.collect()}

    def complete(self, stage: str, marks: Mapping[str, str], root: str, /, **names: str) -> set[str]:
        """Subsets that are stored with the given marks, and whose rows (if any) are still under ``root``."""
        have = self.entries(stage)
        same = {s: have[s][0] for s, m in marks.items() if s in have and have[s][1] == m}
        return {s for s, rows in same.items() if not rows or _has_files(self.spark, _subset_path(self.spark, root, s, **names))}

    def commit(self, stage: str, rows: Mapping[str, int], marks: Mapping[str, str]) -> None:
        """Write the entries of the subsets in ``marks``; those without rows count as empty."""
        if marks:
            new = self.spark.createDataFrame([(s, int(rows.get(s, 0)), m) for s, m in sorted(marks.items())], "subset string, rows long, mark string")
            _save(new.coalesce(1), self.root, ("rows", "mark"), **self.names, stage=stage)


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    """All entries ``(model, task, stage, subset, rows, mark)``; what is done for ``pending``."""
    if not _exists(spark, root):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    text = [F.col(c).cast("string").alias(c) for c in ("model", "task", "stage")]
    return spark.read.parquet(root).select(*text, "subset", "rows", "mark")


def rows_per_subset(df: DataFrame | None, subsets: set[str]) -> dict[str, int]:
    if df is None:
        return {}
    return {r["subset"]: r["count"] for r in df.where(F.col("subset").isin(sorted(subsets))).groupBy("subset").count().collect()}


# ---------------------------------------------------------------- embeddings
def save_embeddings(df: DataFrame, root: str, model: str, task: str, side: str) -> None:
    """K1: ``(subset, id, vec)``, replacing what is stored of these subsets."""
    _save(df, root, ("id", "vec", "source"), model=model, task=task, side=side)


def load_embeddings(spark: SparkSession, root: str, model: str, task: str, side: str) -> DataFrame | None:
    return _load(spark, root, model=model, task=task, side=side)


def _pooled(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_chunks(rows: DataFrame, chunk_rows: int) -> list[DataFrame]:
    """The rows in chunks by hash of the id (none without rows), written to the shared folder: a chunk reads its own files only."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "to-embed")
    rows.write.parquet(f"{path}/all")
    whole = spark.read.schema(rows.schema).parquet(f"{path}/all")
    n = min(MAX_CHUNKS, -(-whole.count() // chunk_rows))
    if n < 2:
        return [whole] * n
    whole.withColumn("embed_chunk", F.pmod(F.xxhash64("subset", "id"), F.lit(n))).write.partitionBy("embed_chunk").parquet(f"{path}/chunks")
    folders = [f"{path}/chunks/embed_chunk={i}" for i in range(n)]
    return [spark.read.schema(rows.schema).parquet(x) for x in folders if _exists(spark, x)]  # one without rows is not written


def embed_missing(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], root: str, model: str, task: str, side: str,
                  input_cols: Sequence[str], chunk_rows: int = 100_000, subsets: set[str] | None = None) -> DataFrame:
    """K1: embeddings of ``rows`` (subset, id, inputs), of which only those are computed that are not stored.

    A stored vector belongs to a row if subset, id and the hash of its inputs are the
    same.  The missing rows are embedded in chunks (by hash of the id, ``chunk_rows``
    each, ``MAX_CHUNKS`` at most), each committed by itself; a killed run goes on
    behind its last commit.  What ``rows`` takes to compute is paid once, not per chunk.  ``embed`` maps (subset, source, id, inputs) to (subset, source, id, vec).
    Vectors of inputs that are gone are taken out at the end, also of ``subsets`` that
    have no rows any more.  Ids are required.
    """
    spark, names = rows.sparkSession, {"model": model, "task": task, "side": side}
    subset = subset_of(rows)
    ident = F.when(F.col("id").isNull(), F.raise_error(F.lit("missing required field id"))).otherwise(F.col("id").cast("string"))
    inputs = [c for c in rows.columns if c not in ("subset", "id")]
    used = [c for c in inputs if c in (*input_cols, "modal")]
    rows = rows.select(subset.alias("subset"), ident.alias("id"), *inputs, row_hash(rows, used).alias("source"))
    on = ["subset", "id", "source"]
    stored = load_embeddings(spark, root, model, task, side)
    if stored is not None and "source" not in stored.columns:
        stored = stored.withColumn("source", F.lit(None).cast("long"))
    missing = rows if stored is None else rows.join(stored.select(*on), on, "left_anti")
    chunks = _in_chunks(missing, chunk_rows)
    for part in chunks:
        vecs = embed(part).select("subset", "id", "vec", F.col("source").cast("long").alias("source"))
        _append(vecs, root, ("id", "vec", "source"), **names)
    now = load_embeddings(spark, root, model, task, side)
    if now is None:
        return spark.createDataFrame([], EMBEDDING_SCHEMA)
    inside = _pooled([x.select("subset") for x in chunks] if chunks and stored is None else [rows.select("subset")])
    mine = {r["subset"] for r in inside.distinct().collect()} | (subsets or set())
    current = now.where(F.col("subset").isin(sorted(mine)))
    if stored is not None and current.count() != rows.count():  # inputs changed: old vectors go
        kept = cut_lineage(current.join(rows.select(*on), on, "left_semi").dropDuplicates(on))
        drop_subsets(spark, root, mine, **names)
        save_embeddings(kept, root, model, task, side)
        now = load_embeddings(spark, root, model, task, side)
    return spark.createDataFrame([], EMBEDDING_SCHEMA) if now is None else now


def save_run(run: DataFrame, root: str, model: str, task: str, stage: str = "full") -> None:
    """K2 / K3: run rows ``(subset, qid, did, score, rk)``; ``stage='filtered'`` for
    candidate-filtered predictions."""
    _save(run, root, ("qid", "did", "score", "rk"), model=model, task=task, stage=stage)


def load_run(spark: SparkSession, root: str, model: str, task: str, stage: str = "full") -> DataFrame | None:
    return _load(spark, root, model=model, task=task, stage=stage)


def save_metrics(metrics: DataFrame, root: str, model: str, task: str) -> None:
    """K4: long metrics ``(subset, metric, k, value)``."""
    _save(metrics, root, ("metric", "k", "value"), model=model, task=task)


def load_metrics(spark: SparkSession, root: str, model: str, task: str) -> DataFrame | None:
    return _load(spark, root, model=model, task=task)


def stored_subsets(df: DataFrame | None) -> set[str]:
    """Subsets that a stored table has rows of (a task names a bounded list of subsets)."""
    return set() if df is None else {r["subset"] for r in df.select("subset").distinct().collect()}


def wide_metrics(metrics: DataFrame, keys: Sequence[str] = ("model", "task", "subset")) -> DataFrame:
    """K4 JSON shape: one row per (model, task, subset), one column per ``metric_at_k``."""
    named = metrics.withColumn("name", metric_name(F.col("metric"), F.col("k")))
    return named.groupBy(*keys).pivot("name").agg(F.first("value"))


def write_metrics_json(metrics: DataFrame, path: str, keys: Sequence[str] = ("model", "task", "subset")) -> None:
    wide_metrics(metrics, keys).coalesce(1).write.mode("overwrite").json(path)


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ("model", "task", "subset")) -> DataFrame:
    """K5: plan entries without a result yet (``left_anti`` against what is done)."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sweep_report(metrics: DataFrame, metric: str = "ndcg", k: int = 10,
                 rows: Sequence[str] = ("model",), cols: str = "task") -> DataFrame:
    """Models x tasks table of one main score (mean over subsets)."""
    main = metrics.where((F.col("metric") == metric) & (F.col("k") == k))
    per = main.groupBy(*rows, cols).agg(F.round(F.avg("value"), 9).alias("value"))
    return per.groupBy(*rows).pivot(cols).agg(F.first("value"))
