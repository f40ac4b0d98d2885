"""Incremental top-k over a stream of corpus vectors.

Corpus rows arrive as a stream; the queries are a static table.  Every
micro-batch is packed into chunks, joined with the (size-checked) query
blocks, scored by the same numpy block scorer as the batch search, and the
partial top-k rows meet the rankings of their team of queries, which are keyed map state of
``transformWithStateInPandas``: an entry per query with at most k ids and scores, so no
watermark is needed.  A document that is delivered again changes nothing.

Only **changed** rankings are written to the state and emitted: a micro-batch that
moves no ranking writes no row, and what is written grows with the changes, not
with queries x batches.  ``run_to_table`` drives such a stream to completion
(``availableNow``); the changes of a micro-batch lie under ``batch=<id>`` (overwritten
by a retry), and the rankings at the end are read from the state itself, through
the state data source, so no snapshot is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import as_double_array
from ..operators.blocks import (CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES, conf_int, n_blocks_for, pack_blocks, pack_partitions,
                                pair_blocks)
from ..operators.score import MAX_BUFFER, TEAM_QUERIES, _row_bytes, _scorer, sort_keys
from ..session import scratch_path

OUT_SCHEMA = "qid string, did string, score double, rk int"
STATE_KEY, STATE_VALUE = "qid string", "dids array<string>, scores array<double>"
#: State keys: the queries are dealt over so many teams by hash, whatever their number, so that a restart finds them again.
STATE_TEAMS = 4096
#: The state lies in RocksDB on the executors' disks and is committed as change logs.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class Ranking(StatefulProcessor):
    """The k best documents so far of every query of a team."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getMapState("top", STATE_KEY, STATE_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[["qid", "did", "score"]] for pdf in rows], ignore_index=True)
        met = set(new["qid"])
        old = {q: (list(dids), list(scores)) for (q,), (dids, scores) in self.top.iterator() if q in met}
        before = pd.DataFrame([(q, d, s) for q, hits in old.items() for d, s in zip(*hits)], columns=["qid", "did", "score"])
        both = pd.concat([before.astype({"score": np.float64}), new], ignore_index=True).drop_duplicates(["qid", "did"], keep="last")
        both["key"] = sort_keys(both["score"].to_numpy(np.float64))
        both = both.sort_values(["qid", "key", "did"], ascending=[True, False, False], ignore_index=True)
        both["rk"] = (both.groupby("qid").cumcount() + 1).astype(np.int32)
        both = both[both["rk"] <= self.k]
        moved = []
        for q, mine in both.groupby("qid"):
            hits = (mine["did"].tolist(), mine["score"].tolist())
            if old.get(q) != hits:
                self.top.updateValue((q,), hits)
                moved.append(q)
        if moved:
            yield both[both["qid"].isin(moved)][["qid", "did", "score", "rk"]]

    def close(self) -> None:
        pass


def _pairs(q: DataFrame, chunks: DataFrame, nq: int, row_bytes: int, k: int, block_bytes: int) -> DataFrame:
    """Every chunk with every query block, spread over the tasks whatever files a micro-batch has.

    Blocks that are broadcast meet the chunks behind a shuffle by block, so a query's k hits leave one task;
    more than that are joined by (block, salt).
    """
    spark, total = q.sparkSession, nq * row_bytes
    nqb = max(n_blocks_for(total, block_bytes), n_blocks_for(nq * k, MAX_BUFFER // 2))
    if total > conf_int(spark, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES):
        return pair_blocks(chunks, pack_blocks(q, "qid", ["qid", "vec"], nqb, out="q_items"), nqb, total)
    nqb = max(nqb, min(2 * spark.sparkContext.defaultParallelism, n_blocks_for(nq, TEAM_QUERIES)))
    blocks = pack_blocks(q, "qid", ["qid", "vec"], nqb, out="q_items").withColumn("blk", F.col("blk").cast("int"))
    sent = chunks.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))))
    return sent.repartitionById(nqb, "blk").join(F.broadcast(blocks), "blk")


def stream_topk(corpus_stream: DataFrame, queries: DataFrame, k: int, *, do_norm: bool = True,
                exclude_identical: bool = False,
                did_col: str = "did", qid_col: str = "qid", vec_col: str = "vec",
                query_block_bytes: int = 16 << 20) -> DataFrame:
    """Streaming DataFrame of updated rankings ``(qid, did, score, rk)``."""
    q = queries.select(F.col(qid_col).cast("string").alias("qid"), as_double_array(vec_col).alias("vec"))
    c = corpus_stream.select(F.col(did_col).cast("string").alias("did"), as_double_array(vec_col).alias("vec"))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    chunks = pack_partitions(c, ["did", "vec"], out="c_items")
    pairs = _pairs(q, chunks, int(stats["n"]), _row_bytes(int(stats["dim"] or 0)), k, query_block_bytes)
    partial = pairs.select("blk", "q_items", "c_items").mapInArrow(
        _scorer(k, do_norm, exclude_identical, [], False), "qid string, did string, score double"
    )
    teams = partial.withColumn("team", F.pmod(F.xxhash64("qid"), F.lit(STATE_TEAMS)).cast("int"))
    return teams.groupBy("team").transformWithStateInPandas(Ranking(k), OUT_SCHEMA, "update", "none")


@contextmanager
def state_settings(spark: SparkSession):
    """The settings of the state store, for as long as a stream starts and runs."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(updates: DataFrame, out_dir: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a ranking stream to completion; return the final ranking per query.

    ``out_dir`` gets the changed rankings of every micro-batch.  A stream that is
    started again with its ``checkpoint`` goes on where it stopped.
    """
    spark: SparkSession = updates.sparkSession
    if out_dir is None or checkpoint is None:
        base = scratch_path(spark, "stream-topk")
        out_dir, checkpoint = out_dir or f"{base}/out", checkpoint or f"{base}/checkpoint"

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    with state_settings(spark):
        query = updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return rankings(spark, checkpoint)


def changes(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(batch, qid, did, score, rk)``: the rankings that each micro-batch changed."""
    return spark.read.schema(OUT_SCHEMA + ", batch int").parquet(out_dir)


def rankings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(qid, did, score, rk)`` of the state after the last committed micro-batch; no rows before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.getPath().getName().isdigit() for s in fs.listStatus(path)):
        return spark.createDataFrame([], OUT_SCHEMA)
    with state_settings(spark):
        state = spark.read.format("statestore").option("stateVarName", "top").load(checkpoint)
        hits = F.arrays_zip(F.col("user_map_value.dids").alias("did"), F.col("user_map_value.scores").alias("score"))
        rows = state.select(F.col("user_map_key.qid").alias("qid"), F.posexplode(hits).alias("i", "hit"))
        return rows.select("qid", "hit.did", "hit.score", (F.col("i") + 1).alias("rk"))
