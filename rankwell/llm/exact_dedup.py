"""Exact deduplication as a stateful stream with a check of the full bytes on hits.

1. The rows are written once to the shared folder with the digest of their
   normalised text and a locator, the number of the row in that table; it also
   orders rows that share a doc_id.
2. A structured stream over digests and locators keeps one state entry per digest
   in RocksDB, without expiry: the row to keep (largest doc_id, with its locator)
   and the number of rows.  Partial aggregation before the shuffle makes a
   group of copies one row per task, however large it is.
3. Hits (rows whose digest has another keeper) are joined with the bytes at the
   keeper's locator and compared in full; only texts of groups of copies are
   shuffled for it.  Digests with a mismatch are grouped again by whole texts.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import ascii_lower, documents, prepare, scratch_path, staged

#: Provider of the keyed state: on local disk, with snapshots in the shared checkpoint folder.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of copies whose digests are sent to every task (32 bytes each); with more, the rows are joined by a shuffle.
BROADCAST_GROUPS = 500_000
#: Rows to drop that are sent to every task (one number each); with more, by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Copies of one group that are compared with the keeper's bytes in one share.
SHARE_ROWS = 256
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Many partitions with little state each: no disk space ahead of need, and only changes are uploaded.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def keyed_state(rows: DataFrame) -> DataFrame:
    """Streaming state per digest: keeper (doc_id, locator) and number of rows; works on a batch too."""
    keeper = F.max(F.struct("doc_id", "locator")).alias("keeper")
    return rows.groupBy("digest").agg(keeper, F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, source: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stateful stream over all that is there; each micro-batch writes the digests it touched.

    A micro-batch that is run again overwrites its own folder, so the table does
    not depend on failures.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    old = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        query = keyed_state(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bounded(df: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


class Deduplication:
    """One run over (doc_id, text): the rows in the shared folder, the final state, and what the byte check found."""

    def __init__(self, docs: DataFrame, digest=sha256_digest, files_per_batch: int = 64):
        self.spark, self.columns = docs.sparkSession, docs.columns
        spark, norm = self.spark, normalised(F.col("text"))
        path = scratch_path(spark, "exact")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("source_row")
        table = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), digest(norm).alias("digest"), F.monotonically_increasing_id().alias("locator"))
        table.write.option("compression", "zstd").parquet(path)
        # The locator is stored with the row: the partition of the table's writer and the row's number in it.
        self.rows = spark.read.schema(table.schema).parquet(path)
        base = scratch_path(spark, "exact-stream")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        run_stream(spark, stream.select("doc_id", "digest", "locator"), f"{base}/state", f"{base}/checkpoint")
        changes = spark.read.schema("digest binary, keeper struct<doc_id: bigint, locator: bigint>, group_size bigint, batch int").parquet(f"{base}/state")
        # The last change of each digest is its final state.
        last = changes.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s"))
        self.state = staged(last.select(F.col("digest").alias("s_digest"), F.col("s.keeper.doc_id").alias("keep_id"), F.col("s.keeper.locator").alias("keeper"), F.col("s.group_size").alias("group_size")), "exact-state")
        self._check_bytes()

    def _check_bytes(self) -> None:
        """Compare the full normalised bytes of every hit with those at the keeper's locator."""
        # A large group is dealt into shares, and the keeper's bytes go to each of them.
        shares = F.ceil(F.col("group_size") / SHARE_ROWS).cast("long").alias("shares")
        groups = self.state.where("group_size > 1").select("s_digest", "keeper", shares)
        copies = self.rows.select("digest", "locator", normalised(F.col("source_row.text")).alias("norm")).join(_bounded(groups, BROADCAST_GROUPS), F.col("digest") == F.col("s_digest"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("k_share")
        content = copies.where("locator = keeper").select(F.col("digest").alias("k_digest"), F.col("norm").alias("k_norm"), each)
        hits = copies.where("locator <> keeper").select("digest", "norm", F.pmod(F.xxhash64("locator"), F.col("shares")).alias("share"))
        same = (F.col("digest") == F.col("k_digest")) & (F.col("share") == F.col("k_share"))
        unequal = hits.join(content, same & (F.col("norm") != F.col("k_norm")))
        self.collided = staged(unequal.select(F.col("digest").alias("x_digest")).distinct(), "exact-collided")
        self.has_collisions = not self.collided.isEmpty()

    def decided(self) -> DataFrame:
        """(doc_id, locator, digest, norm, keep_id, group_size, kept) of every row; norm is read only if it is used."""
        rows = self.rows.select("doc_id", "locator", "digest", normalised(F.col("source_row.text")).alias("norm"))
        found = rows.join(self.state, F.col("digest") == F.col("s_digest"), "left").drop("s_digest")
        if self.has_collisions:
            # Texts that differ but share a digest: group those by the whole text.
            marked = found.join(self.collided, F.col("digest") == F.col("x_digest"), "left")
            again = marked.where("x_digest is not null").select("doc_id", "locator", "digest", "norm")
            exact = again.groupBy(F.col("digest").alias("g_digest"), F.col("norm").alias("g_norm")).agg(F.max(F.struct("doc_id", "locator")).alias("k"), F.count(F.lit(1)).alias("group_size"))
            again = again.join(exact, (F.col("digest") == F.col("g_digest")) & (F.col("norm") == F.col("g_norm")))
            again = again.select("doc_id", "locator", "digest", "norm", F.col("k.doc_id").alias("keep_id"), F.col("k.locator").alias("keeper"), "group_size")
            found = marked.where("x_digest is null").drop("x_digest").unionByName(again)
        return found.select("doc_id", "locator", "digest", "norm", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("locator") == F.col("keeper")).alias("kept"))

    def kept_rows(self) -> DataFrame:
        """The rows that stay, with the columns of the input."""
        gone = staged(self.decided().where(~F.col("kept")).select(F.col("locator").alias("gone")), "exact-gone")
        kept = self.rows.join(_bounded(gone, BROADCAST_ROWS), F.col("locator") == F.col("gone"), "left_anti")
        return kept.select(*[F.col(f"source_row.`{c}`").alias(c) for c in self.columns])


def deduplicate(docs: DataFrame, digest=sha256_digest, files_per_batch: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id stays; a null doc_id is smaller than any
    other; of rows that share the largest doc_id, exactly one stays.  Columns
    beside doc_id and text may have any names.  An empty table gives no rows.
    """
    run = Deduplication(docs, digest, files_per_batch)
    # The state's digest is the SHA-256 unless another one was asked for.
    sha = F.lower(F.hex("digest")) if digest is sha256_digest else F.sha2(F.col("norm").cast("binary"), 256)
    return run.decided().select("doc_id", "keep_id", "group_size", "kept", sha.alias("text_sha256"))


def keep_first_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return Deduplication(docs, **options).kept_rows()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents: doc_id, keep_id, group_size, kept, text_sha256."""
    prepare(spark)
    return deduplicate(documents(spark, sf_dir))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
