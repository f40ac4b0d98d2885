"""Exact similarity search: score queries against a corpus, keep the top k.

Plan (J1 / V2 / V3 / V4 / T2):

* Query vectors are packed into blocks of bounded bytes; how many follows
  from a size check of the query side (``operators.blocks``).
* Without a group restriction, corpus vectors are packed into chunk rows per
  input partition (``mapInArrow``, no shuffle; an input with fewer partitions
  than cores is first spread round-robin) and meet the query blocks by an
  equi-join on the block id (broadcast when the query side passes the size
  check, a salted 2-D block join otherwise).
* A deep search (k near or above a task's share of a small corpus) would emit every
  pair that way; there the corpus is broadcast, after a check of its size, and the
  queries are divided over the cores, so k rows per query leave the scorer.
* With a group restriction (score only pairs with equal group values, e.g. a
  conversation or a subset) and few groups, query blocks that pass the size check
  are broadcast per group and the corpus is not shuffled at all.  Larger ones are divided
  into teams inside their group; a chunk goes once to each team of its group.  With many groups both
  sides are hashed into bounded blocks inside their group; a corpus block goes once
  to its (group, block), and the group's query blocks are copied to each.  Only
  groups of more than one block are looked up, in a table that is broadcast while
  it is small, so a hot group is spread over many tasks whichever side makes it hot.
* Every (block, chunk) row is scored by numpy matmuls over slices of the
  block's queries (each score matrix stays below ``MAX_SCORE_CELLS``).  A task
  keeps the running k-th best key of every query it meets, buffers only hits
  that reach it, and emits at most k hits per query and part when its input
  ends or the buffer is full; Spark's window limit merges these lists.

``corpus_part`` names a corpus column (e.g. a subset) that splits the ranking:
the result holds the top k per (part, query) from one pass over the corpus.

Scores are cosine (``do_norm``) or dot products in float64 with NaN mapped to
-1, saved as they are.  They are ranked by ``functions.vectors.sort_key``
(relative to their own scale), so duplicate vectors tie exactly; ties go to
the larger document id (string order), as a (score, id) heap keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.vectors import KEY_BITS, NORM_EPS, as_double_array
from .blocks import (CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES, SPREAD_BYTES, bounded_broadcast, conf_int, n_blocks_for, pack_blocks,
                     pack_groups, pack_partitions, pair_blocks, plan_bytes, spread)
from .rank import top_k

DEFAULT_QUERY_BLOCK_BYTES = 16 << 20
DEFAULT_CHUNK_ROWS = 4096
# Upper bound of one dense score matrix inside a task (cells, 8 bytes each):
# query rows of a block are scored in slices so that slice x chunk stays below it.
MAX_SCORE_CELLS = 4 << 20
# Unit vectors sum to a product with about this absolute error.
COSINE_NOISE = 2.0**-46
# Vectors of the queries that a task holds at once; queries that are worth a task of their own.
TEAM_BYTES, TEAM_QUERIES = 32 << 20, 512
# The same where they travel with every chunk, in the block join.
JOINED_BYTES = 4 << 20
# Documents that set a query's first bound; float64 scores are computed at once for so many pairs; from one in so many pairs
# on, for all of them; rows of a batch of hits.
SEED_ROWS, PAIR_ROWS, DENSE_SHARE, EMIT_ROWS = 256, 1 << 15, 8, 1 << 16
# Queries and documents of a matrix of float32 products: it stays in a processor's cache until it was compared.
CLOSE_QUERIES, CLOSE_DOCS = 1024, 512
# Hits that a task buffers before it cuts them to k per query, and emits them if more than this share of them is left.
MAX_BUFFER, FULL_SHARE = 4 << 20, 0.75
# Cells of a matrix that joins new keys to the best ones; ids of documents that a task holds before it drops those without a hit.
MERGE_CELLS, MAX_IDS = 1 << 19, 1 << 18
# Groups of more than one block that are broadcast (one row each); beyond it they are joined by a shuffle.
MAX_BROADCAST_GROUPS = 100_000
# Groups up to which the corpus is packed where it lies: many small groups would be cut into a row or two per batch.
MAX_LOCAL_GROUPS = 64
# From this k on, a small corpus whose shares per task are under so many times k is sent to the queries.
DEEP_K, DEEP_SHARE = 257, 4


def _row_bytes(dim: int) -> int:
    return dim * 8 + 64


# ---------------------------------------------------------------- pairing
def _pairs_global(q: DataFrame, c: DataFrame, nq: int, dim: int, k: int, block_bytes: int, part: bool,
                  broadcast_bytes: int | None) -> DataFrame:
    fields = ["did", "vec", *(["part"] if part else [])]
    if _is_deep(c, k, dim, part):
        # every task would emit nearly all its documents for every query: divide the queries instead
        cores = c.sparkSession.sparkContext.defaultParallelism
        qblocks = pack_blocks(q, "qid", ["qid", "vec"], cores, out="q_items").repartition(cores, "blk")
        chunks = F.broadcast(pack_partitions(c, fields, out="c_items").withColumn("one", F.pmod("cb", F.lit(1))))
        return qblocks.withColumn("one", F.pmod("blk", F.lit(1))).join(chunks, "one").drop("one")
    total = nq * _row_bytes(dim)
    # the running lists (k keys per query) are bounded like the vectors
    nqb, lists = n_blocks_for(total, block_bytes), n_blocks_for(nq * k, MAX_BUFFER // 2)
    chunks = pack_partitions(spread(c), fields, out="c_items")
    budget = conf_int(c.sparkSession, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES) if broadcast_bytes is None else broadcast_bytes
    if max(nqb, lists) == 1 and total <= budget:
        return pair_blocks(chunks, pack_blocks(q, "qid", ["qid", "vec"], 1, out="q_items"), 1, total, broadcast_bytes)
    if broadcast_bytes is not None:
        return _pairs_joined(q, chunks, nq, nqb, max(lists, n_blocks_for(total, JOINED_BYTES)))
    return _pairs_streamed(q, chunks, nq, nqb, max(lists, n_blocks_for(total, TEAM_BYTES)))


def _teams(q: DataFrame, nq: int, least: int) -> tuple[int, int]:
    """Number of teams of query blocks, and of cells of a team."""
    cores = q.sparkSession.sparkContext.defaultParallelism
    teams = max(least, min(2 * cores, math.ceil(nq / TEAM_QUERIES)))
    return teams, math.ceil(2 * cores / teams) if teams < cores else 1


def _pairs_joined(q: DataFrame, chunks: DataFrame, nq: int, nqb: int, least: int) -> DataFrame:
    """The salted block join by teams: the blocks of a team make one row, so a chunk is sent once per team, not per block."""
    teams, salts = _teams(q, nq, least)
    blocks = pack_blocks(q, "qid", ["qid", "vec"], max(nqb, teams), out="q_items")
    team = F.pmod("blk", F.lit(teams)).cast("int").alias("blk")
    rows = blocks.select(team, "q_items").groupBy("blk").agg(F.flatten(F.collect_list("q_items")).alias("q_items"))
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    sent = chunks.select("c_items", F.pmod(F.xxhash64("cb"), F.lit(salts)).cast("bigint").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("blk"))
    return sent.join(rows.hint("shuffle_hash"), ["blk", "salt"]).drop("salt")


def _pairs_streamed(q: DataFrame, chunks: DataFrame, nq: int, nqb: int, least: int) -> DataFrame:
    """The query blocks in teams, each team in one task or a few (its cells), and every chunk once to each team.

    Rows hold a block or a chunk: in the partition of a cell its blocks come first and
    its chunks follow, so a block and a chunk cross the shuffle once per cell, whatever the size of
    a block, and a task holds one team and one chunk.  Queries are divided before the corpus is: a
    query's k hits leave as many tasks as the team has cells.
    """
    teams, salts = _teams(q, nq, least)
    blocks = pack_blocks(q, "qid", ["qid", "vec"], max(nqb, teams), out="q_items")
    kinds = {f.name: f.dataType for df in (blocks, chunks) for f in df.schema.fields}

    def upto(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    sent = blocks.select((F.pmod("blk", F.lit(teams)) * salts).alias("first"), "q_items", upto(salts).alias("i")).select(
        (F.col("first") + F.col("i")).cast("int").alias("blk"), F.lit(0).alias("side"), "q_items", F.lit(None).cast(kinds["c_items"]).alias("c_items"))
    met = chunks.select(F.pmod(F.xxhash64("cb"), F.lit(salts)).alias("salt"), "c_items", upto(teams).alias("i")).select(
        (F.col("i") * salts + F.col("salt")).cast("int").alias("blk"), F.lit(1).alias("side"), F.lit(None).cast(kinds["q_items"]).alias("q_items"), "c_items")
    return sent.unionByName(met).repartitionById(teams * salts, "blk").sortWithinPartitions("blk", "side")


def _pairs_streamed_groups(q: DataFrame, c: DataFrame, groups: list[str], dim: int, k: int, part: bool) -> DataFrame | None:
    """``_pairs_streamed`` inside every group, or None beyond ``MAX_LOCAL_GROUPS``: a chunk goes once to each team of its group.

    The cells of all groups are numbered one after the other.  Queries and documents are packed where they
    lie, so no side is collected into large rows.
    """
    named = F.coalesce(*[F.when(F.col(g).isNull(), F.lit(True)) for g in groups]).isNull()  # a null equals no group
    q, c = q.where(named), c.where(named)
    counts = q.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LOCAL_GROUPS + 1).collect()
    if len(counts) > MAX_LOCAL_GROUPS:
        return None
    cells, n_cells = [], 0
    for row in counts:
        teams, salts = _teams(q, row["n"], max(n_blocks_for(row["n"] * k, MAX_BUFFER // 2), n_blocks_for(row["n"] * _row_bytes(dim), TEAM_BYTES)))
        cells.append((*row[:-1], n_cells, teams, salts))
        n_cells += teams * salts
    types = [f"`{g}` {q.schema[g].dataType.simpleString()}" for g in groups]
    cells = F.broadcast(q.sparkSession.createDataFrame(cells, ", ".join([*types, "_first int", "_teams int", "_salts int"])))

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_i")

    team = F.pmod(F.xxhash64("qid"), F.col("_teams")).cast("int").alias("_team")
    qblocks = pack_groups(q.join(cells, groups).select(*groups, team, "qid", "vec"), [*groups, "_team"], ["qid", "vec"], out="q_items").join(cells, groups)
    chunks = pack_groups(spread(c), groups, ["did", "vec", *(["part"] if part else [])], out="c_items").join(cells, groups)
    salt = F.pmod(F.xxhash64(F.col("c_items")[0]["did"]), F.col("_salts")).cast("int")
    kinds = {f.name: f.dataType for df in (qblocks, chunks) for f in df.schema.fields}
    sent = qblocks.select("*", upto("_salts")).select(
        *groups, (F.col("_first") + F.col("_team") * F.col("_salts") + F.col("_i")).alias("blk"), F.lit(0).alias("side"), "q_items", F.lit(None).cast(kinds["c_items"]).alias("c_items"))
    met = chunks.select("*", salt.alias("_salt"), upto("_teams")).select(
        *groups, (F.col("_first") + F.col("_i") * F.col("_salts") + F.col("_salt")).alias("blk"), F.lit(1).alias("side"), F.lit(None).cast(kinds["q_items"]).alias("q_items"), "c_items")
    return sent.unionByName(met).repartitionById(max(1, n_cells), "blk").sortWithinPartitions("blk", "side")


def _is_deep(c: DataFrame, k: int, dim: int, part: bool) -> bool:
    """Whether a task's share of the corpus would be under ``DEEP_SHARE`` times k, while all of it is small enough to broadcast."""
    spark = c.sparkSession
    budget = conf_int(spark, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES)
    cores = spark.sparkContext.defaultParallelism
    if k < DEEP_K or part or plan_bytes(c) > SPREAD_BYTES * cores:
        return False
    most = min(budget // _row_bytes(dim), DEEP_SHARE * k * cores)
    return c.limit(most + 1).count() <= most


def _block_counts(df: DataFrame, groups: list[str], rows: int, out: str) -> DataFrame:
    """Groups of more than one block of ``rows`` rows, with the number of blocks."""
    counts = df.groupBy(*[F.col(g).alias(f"_{out}_{g}") for g in groups]).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("bigint").alias(out))
    return bounded_broadcast(counts.where(F.col(out) > 1), MAX_BROADCAST_GROUPS)


def _with_blocks(df: DataFrame, counts: DataFrame, groups: list[str], out: str) -> DataFrame:
    """Adds the number of blocks of the row's group (1 unless ``counts`` names more)."""
    same = [F.col(g).eqNullSafe(F.col(f"_{out}_{g}")) for g in groups]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    joined = df.join(counts, cond, "left").drop(*[f"_{out}_{g}" for g in groups])
    return joined.withColumn(out, F.coalesce(out, F.lit(1).cast("bigint")))


def _in_groups(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(g).cast("string") for g in groups]).isNotNull())


def _pairs_broadcast_groups(q: DataFrame, c: DataFrame, groups: list[str], dim: int, block_bytes: int, part: bool) -> DataFrame:
    """Query blocks of all groups go to every task; the corpus stays where it is, packed per group and batch."""
    per_block = max(1, block_bytes // _row_bytes(dim))
    counts = _block_counts(q, groups, per_block, "nqb")
    blocks = _with_blocks(q, counts, groups, "nqb").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")))
    qblocks = blocks.groupBy(*groups, "qb").agg(F.collect_list(F.struct("qid", "vec")).alias("q_items"))
    chunks = pack_groups(spread(c), groups, ["did", "vec", *(["part"] if part else [])], out="c_items")
    return chunks.join(F.broadcast(qblocks), groups).withColumn("blk", F.col("qb"))


def _pairs_grouped(
    q: DataFrame, c: DataFrame, groups: list[str], dim: int, block_bytes: int, chunk_rows: int, part: bool
) -> DataFrame:
    """Both sides in bounded blocks inside their group.  A corpus block is shuffled once, to the key (group, block);
    the query blocks of the group are copied to each of its corpus blocks."""
    per_block = max(1, block_bytes // _row_bytes(dim))
    q, c = _in_groups(q, groups), _in_groups(c, groups)
    nq, nc = _block_counts(q, groups, per_block, "nqb"), _block_counts(c, groups, chunk_rows, "ncb")

    def packed(df, counts, key, n, items, out):
        blocks = _with_blocks(df, counts, groups, n).withColumn(key, F.pmod(F.xxhash64(items[0]), F.col(n)))
        # an explicit shuffle on (group, block): one on the group alone would put a hot group into one task
        return blocks.repartition(*groups, key).groupBy(*groups, key).agg(F.collect_list(F.struct(*items)).alias(out))

    qblocks = packed(q, nq, "qb", "nqb", ["qid", "vec"], "q_items")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ncb") - 1)).alias("cb")
    qblocks = _with_blocks(qblocks, nc, groups, "ncb").select(*groups, "qb", "q_items", copies)
    chunks = packed(c, nc, "cb", "ncb", ["did", "vec", *(["part"] if part else [])], "c_items")
    return qblocks.join(chunks, [*groups, "cb"]).withColumn("blk", F.col("qb"))


# ---------------------------------------------------------------- scoring
def _matrix(items: pa.Array, what: str):
    fields = items.flatten()
    ids = np.asarray(fields[0].to_numpy(zero_copy_only=False), dtype=object)
    vecs = fields[1]
    lens = np.diff(vecs.offsets.to_numpy())
    if len(lens) and (lens != lens[0]).any():
        raise ValueError(f"{what} vectors differ in length")
    dim = int(lens[0]) if len(lens) else 0
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    parts = None
    if len(fields) > 2:
        parts = np.asarray(fields[2].to_numpy(zero_copy_only=False), dtype=object)
    return ids, flat.reshape(len(ids), dim), parts


def _normalise(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.maximum(n, NORM_EPS)


def sort_keys(scores: np.ndarray) -> np.ndarray:
    """``functions.vectors.sort_key`` of an array."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        exponent = np.maximum(np.floor(np.log2(np.abs(scores))), -900.0)
        scale = np.exp2(KEY_BITS - exponent)
        key = np.rint(scores * scale) / scale
    return np.where(scores == 0, 0.0, np.where(np.isinf(scores), scores, key))


def _settled(s: np.ndarray, do_norm: bool) -> np.ndarray:
    """V3: NaN is -1; a cosine below ``COSINE_NOISE`` is the rounding error of 0; there is no negative zero."""
    s[np.isnan(s)] = -1.0
    if do_norm:
        s[np.abs(s) < COSINE_NOISE] = 0.0
    s += 0.0
    return s


def id_ranks(dids: np.ndarray) -> np.ndarray:
    """Position of every id in string order (the tie-break key)."""
    r = np.empty(len(dids), np.int64)
    r[np.argsort(dids.astype(str), kind="stable")] = np.arange(len(dids))
    return r


def partial_topk(keys: np.ndarray, dids: np.ndarray, k: int, valid: np.ndarray | None = None,
                 id_rank: np.ndarray | None = None):
    """Exact top-k of every row by (key desc, id desc) -> (row idx, col idx).

    One vectorised partition finds the k-th key of each row; only rows with
    several ids at that key are sorted by id.
    """
    nq, nc = keys.shape
    if nc == 0 or nq == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if valid is not None:
        keys = np.where(valid, keys, -np.inf)
    if nc <= k:
        mask = np.ones(keys.shape, bool)
    else:
        kth = np.partition(keys, nc - k, axis=1)[:, nc - k, None]
        mask = keys >= kth
        over = np.flatnonzero(mask.sum(axis=1) > k)
        if len(over):  # ties at the cut: the larger ids stay
            id_rank = id_ranks(dids) if id_rank is None else id_rank
            tied = keys[over] == kth[over]
            rank = np.where(tied, id_rank[None, :], -1)
            free = k - (keys[over] > kth[over]).sum(axis=1)
            order = np.argsort(-rank, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(nc)[None, :], axis=1)
            mask[over] = (keys[over] > kth[over]) | (tied & (place < free[:, None]))
    if valid is not None:
        mask &= valid
    return np.nonzero(mask)


class _Running:
    """Hits of the queries that a task scores together, cut to k per query and part."""

    def __init__(self, keep: list, queries: "_Queries", k: int):
        self.keep, self.queries, self.k = keep, queries, k
        self.floor: dict = {}  # part -> (n queries, k) best keys so far, if they fit
        self.low: dict = {}  # part -> the k-th of them
        self.seen: dict = {}  # part -> documents met
        self.dids: list[np.ndarray] = []
        self.n_dids, self.most_dids = 0, MAX_IDS
        self.rows: list[tuple] = []  # (part number, query, document number, key, score)
        self.parts: list = []
        self.size = 0

    def start(self, part) -> None:
        if part not in self.low:
            n = len(self.queries.ids)
            self.floor[part] = np.full((n, self.k), -np.inf) if n * self.k <= MAX_BUFFER else None
            self.low[part] = np.full(n, -np.inf)
            self.seen[part] = 0
            self.parts.append(part)

    def offer(self, part, rows: np.ndarray, r: np.ndarray, d: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """Hits of one slice: r (ascending) are places in ``rows``, the slice's queries; d are documents of the last chunk."""
        best = self.floor[part]
        if best is not None:
            enough = key >= self.low[part][rows[r]]
            r, d, key, score = r[enough], d[enough], key[enough], score[enough]
            if len(r):
                self._merge(best, self.low[part], rows, r, key)
                enough = key >= self.low[part][rows[r]]
                r, d, key, score = r[enough], d[enough], key[enough], score[enough]
        if len(r):
            number = np.full(len(r), self.parts.index(part), np.int32)
            self.rows.append((number, rows[r].astype(np.int32), (d + self.n_dids).astype(np.int32), key, score))
            self.size += len(r)

    def _merge(self, best: np.ndarray, low: np.ndarray, rows: np.ndarray, r: np.ndarray, key: np.ndarray) -> None:
        """The best keys and their bound with new keys, a few queries at a time: the matrix of both stays small whatever k is."""
        met, at, n = np.unique(r, return_inverse=True, return_counts=True)
        start = np.concatenate([[0], np.cumsum(n)])
        step = max(1, MERGE_CELLS // (self.k + int(n.max())))
        for lo in range(0, len(met), step):
            some = met[lo:lo + step]
            new = slice(start[lo], start[lo + len(some)])
            fresh = np.full((len(some), n[lo:lo + step].max()), -np.inf)
            fresh[at[new] - lo, np.arange(new.start, new.stop) - start[at[new]]] = key[new]
            mine = rows[some]
            both = np.concatenate([best[mine], fresh], axis=1)
            best[mine] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k:]
            low[mine] = best[mine].min(axis=1)

    def chunk_done(self, dids: np.ndarray) -> None:
        self.dids.append(dids)
        self.n_dids += len(dids)

    def cut(self, final: bool = False) -> None:
        """Drop hits below the k-th best key; at the end, or when ties leave too many, keep exactly the k best of every (part, query)."""
        if not self.rows:
            self.dids, self.n_dids = [], 0
            return
        for i, row in enumerate(self.rows):  # one by one, so that what is dropped is not copied first
            self.rows[i] = self._reaching(row)
        columns, self.rows = list(zip(*self.rows)), []
        for i, pieces in enumerate(columns):
            columns[i] = np.concatenate(pieces)
        del pieces
        part, q, d, key, score = columns
        del columns
        dids = np.concatenate(self.dids)
        used = np.zeros(len(dids), bool)
        used[d] = True
        d = (np.cumsum(used, dtype=np.int32) - np.int32(1))[d]
        dids = dids[used]
        if final or len(q) > FULL_SHARE * MAX_BUFFER:
            rank = id_ranks(dids)
            order = np.lexsort((-rank[d], -key, q, part))
            part, q, d, key, score = part[order], q[order], d[order], key[order], score[order]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (part[1:] != part[:-1])])
            start = np.flatnonzero(new)
            keep = np.arange(len(q)) - start[np.cumsum(new) - 1] < self.k
            part, q, d, key, score = part[keep], q[keep], d[keep], key[keep], score[keep]
        self.dids, self.n_dids, self.most_dids = [dids], len(dids), max(MAX_IDS, 2 * len(dids))
        self.rows = [(part, q, d, key, score)]
        self.size = len(q)

    def emitted(self) -> None:
        """Forget the hits, not the bounds: later ones must still reach the k-th best key."""
        self.rows, self.size = [], 0
        self.dids, self.n_dids, self.most_dids = [], 0, MAX_IDS

    def _reaching(self, row: tuple) -> tuple:
        """The hits of buffered rows that still reach the k-th best key."""
        part, q, _, key, _ = row
        keep = np.ones(len(q), bool)
        for number in np.flatnonzero(np.bincount(part)):
            mine = part == number
            keep[mine] = key[mine] >= self.low[self.parts[number]][q[mine]]
        return tuple(x[keep] for x in row)


class _Queries:
    """Query vectors, and the same as float32 of length 1 where a bound of the rounding error holds."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, do_norm: bool):
        self.ids, self.vecs = ids, _normalise(vecs) if do_norm else vecs
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((self.vecs * self.vecs).sum(axis=1))
            self.plain = (self.norm > (0.5 if do_norm else 1e-100)) & (self.norm < 1e100)
            unit = self.vecs / np.where(self.plain, self.norm, 1.0)[:, None]
        unit[~self.plain] = 0.0
        self.unit = unit.astype(np.float32)
        self.index = pd.Index(pd.unique(pd.Series(ids, dtype=object)))
        self.codes = self.index.get_indexer(ids)


class _Documents:
    """Document vectors of one part of a chunk, and the same as float32, divided by the greatest length."""

    def __init__(self, part, at: np.ndarray, ids: np.ndarray, vecs: np.ndarray):
        self.part, self.at, self.ids, self.vecs = part, at, ids, vecs
        with np.errstate(all="ignore"):
            norm = np.sqrt((vecs * vecs).sum(axis=1))
            self.odd = ~(norm < 1e100)
            self.most = float(norm[~self.odd].max(initial=0.0))
            self.scaled = np.where(self.odd[:, None], 0.0, vecs / (self.most or 1.0)).astype(np.float32)


def _places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask with few true cells: eight cells are looked at as one number first."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    w, cell = np.nonzero(flat.reshape(-1, 8)[words])
    return words[w] * 8 + cell


def _close_pairs(q: _Queries, rows: np.ndarray, docs: _Documents, span: slice, low: np.ndarray):
    """Pairs (place in ``rows``, place in the chunk part) that may reach the keys ``low``, or None if they are many.

    Products of float32 vectors of length 1 at most err by less than (dim + 3) / 2^24; pairs
    closer than that to the bound stay, and their scores are computed in float64.
    """
    bound = low[rows] / (q.norm[rows] * docs.most) - (q.vecs.shape[1] + 16) * 2.0**-24
    with np.errstate(over="ignore"):
        bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
    unit, scaled, odd = q.unit[rows], docs.scaled[span], docs.odd[span]
    found, most = [], unit.shape[0] * scaled.shape[0] // DENSE_SHARE
    for r0 in range(0, len(unit), CLOSE_QUERIES):
        for c0 in range(0, len(scaled), CLOSE_DOCS):
            near = unit[r0:r0 + CLOSE_QUERIES] @ scaled[c0:c0 + CLOSE_DOCS].T >= bound[r0:r0 + CLOSE_QUERIES, None]
            near[:, odd[c0:c0 + CLOSE_DOCS]] = True
            at = _places(near)
            most -= len(at)
            if most < 0:
                return None
            r, c = np.divmod(at, near.shape[1])
            found.append((r + r0, c + c0))
    r, c = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(r, kind="stable")
    return r[order], c[order] + span.start


def _scorer(k: int, do_norm: bool, exclude_identical: bool, keep: Sequence[str], part: bool):
    """Rows (keep..., blk, q_items, c_items) -> at most k hits per query, part and task (unless the buffer fills).

    A row has a block of queries and a chunk of documents that meet, or one of them only
    (``_pairs_streamed``): then the blocks before a chunk are held for all chunks that follow.
    """

    def exact(q: _Queries, rows: np.ndarray, r: np.ndarray, c: np.ndarray, docs: _Documents) -> np.ndarray:
        out = np.empty(len(r))
        with np.errstate(invalid="ignore", over="ignore"):
            for lo in range(0, len(r), PAIR_ROWS):
                at = slice(lo, lo + PAIR_ROWS)
                out[at] = np.einsum("ij,ij->i", q.vecs[rows[r[at]]], docs.vecs[c[at]])
        return _settled(out, do_norm)

    def score_rows(mine: _Running, rows: np.ndarray, docs: _Documents, span: slice, codes: np.ndarray, close: bool) -> None:
        q = mine.queries
        step = max(1, MAX_SCORE_CELLS // max(1, span.stop - span.start))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            pairs = _close_pairs(q, some, docs, span, mine.low[docs.part]) if close else None
            if pairs is not None:
                r, c = pairs
                if exclude_identical:
                    other = q.codes[some[r]] != codes[c]
                    r, c = r[other], c[other]
                s = exact(q, some, r, c, docs)
                mine.offer(docs.part, some, r, docs.at[c], sort_keys(s), s)
                continue
            for low in range(0, len(some), max(1, step // 4)):
                few = some[low:low + max(1, step // 4)]
                with np.errstate(invalid="ignore", over="ignore"):
                    s = _settled(q.vecs[few] @ docs.vecs[span].T, do_norm)
                keys = sort_keys(s)
                valid = q.codes[few][:, None] != codes[span][None, :] if exclude_identical else None
                r, c = partial_topk(keys, docs.ids[span], k, valid)
                s = exact(q, few, r, c + span.start, docs)  # one formula for all hits: equal vectors score equal
                mine.offer(docs.part, few, r, docs.at[c + span.start], sort_keys(s), s)

    def score_chunk(mine: _Running, c_items: pa.Array) -> None:
        dids, cm, parts = _matrix(c_items, "corpus")
        q = mine.queries
        if len(q.ids) == 0 or len(dids) == 0:
            return
        if q.vecs.shape[1] != cm.shape[1]:
            raise ValueError(f"query dim {q.vecs.shape[1]} != corpus dim {cm.shape[1]}")
        if do_norm:
            cm = _normalise(cm)
        groups = [(None, np.arange(len(dids)))]
        if part:
            pv = np.array(["\x00" if p is None else p for p in parts], dtype=object)
            groups = [(p, np.nonzero(pv == p)[0]) for p in dict.fromkeys(pv)]
        for p, idx in groups:
            docs = _Documents(p, idx, dids[idx], cm[idx])
            mine.start(p)
            codes = q.index.get_indexer(docs.ids) if exclude_identical else None
            lo = 0
            while lo < len(idx):  # a few documents set the bounds for the next, more and more of them
                span = slice(lo, min(len(idx), lo + max(SEED_ROWS, 4 * k, 3 * mine.seen[p])))
                close = q.plain & (mine.low[p] > -np.inf) if docs.most > (0.5 if do_norm else 1e-100) else np.zeros(len(q.ids), bool)
                for rows, quick in ((np.flatnonzero(close), True), (np.flatnonzero(~close), False)):
                    if len(rows):
                        score_rows(mine, rows, docs, span, codes, quick)
                mine.seen[p] += span.stop - span.start
                lo = span.stop
        mine.chunk_done(dids)

    def score_row(row: pa.RecordBatch, running: dict, held: list):
        own = [row.column(name)[0].as_py() for name in keep]
        key = (*own, row.column("blk")[0].as_py())
        items = row.column("q_items")
        if items.null_count:
            if held:
                ids, vecs = (np.concatenate(x) for x in zip(*held))
                running[key] = _Running(own, _Queries(ids, vecs, do_norm), k)
                held.clear()
            if key in running:
                score_chunk(running[key], row.column("c_items").flatten())
            return
        if row.column("c_items").null_count:
            held.append(_matrix(items.flatten(), "query")[:2])
            return
        qids, qm, _ = _matrix(items.flatten(), "query")
        if key not in running:
            running[key] = _Running(own, _Queries(qids, qm, do_norm), k)
        elif not np.array_equal(running[key].queries.ids, qids):
            raise ValueError("a query block changed within a task")
        score_chunk(running[key], row.column("c_items").flatten())

    def emit(running: dict, schema: pa.Schema):
        for one in running.values():
            one.cut(final=True)
            dids = np.concatenate(one.dids) if one.dids else np.empty(0, object)
            for whole in one.rows:
                for lo in range(0, len(whole[0]), EMIT_ROWS):
                    number, q, d, _, score = (x[lo:lo + EMIT_ROWS] for x in whole)
                    cols = [pa.array([v] * len(q), schema.field(name).type) for v, name in zip(one.keep, keep)]
                    if part:
                        names = np.array([None if x == "\x00" else x for x in one.parts], dtype=object)
                        cols.append(pa.array(names[number], pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(one.queries.ids[q], pa.string()), pa.array(dids[d], pa.string()), pa.array(score, pa.float64())],
                        names=[*keep, *(["part"] if part else []), "qid", "did", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict = {}
        held: list = []
        schema = None
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if running and not held and row.column("c_items").null_count:
                    yield from emit(running, schema)  # the blocks of another cell begin
                    running.clear()
                score_row(row, running, held)
                for one in running.values():
                    if one.n_dids > one.most_dids:
                        one.cut()
                if sum(x.size for x in running.values()) > MAX_BUFFER:
                    for one in running.values():
                        one.cut()
                    if sum(x.size for x in running.values()) > FULL_SHARE * MAX_BUFFER:
                        yield from emit(running, schema)
                        if row.column("q_items").null_count:  # the queries of the cell meet the chunks that follow, too
                            for one in running.values():
                                one.emitted()
                        else:
                            running.clear()
        if running:
            yield from emit(running, schema)

    return run


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    do_norm: bool = True,
    group_cols: Sequence[str] = (),
    corpus_part: str | None = None,
    exclude_identical: bool = False,
    qid_col: str = "qid",
    did_col: str = "did",
    vec_col: str = "vec",
    query_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Top-``k`` documents per query -> ``(*group_cols, [part], qid, did, score, rk)``.

    ``group_cols``: score only pairs with equal values in these columns.
    ``corpus_part``: rank separately within each value of this corpus column
    (output column keeps the name).  ``exclude_identical``: never return the
    pair ``qid == did`` (J5 applied before the cut).  ``broadcast_bytes``
    overrides the broadcast budget of the query side.  Ids compare as strings.
    """
    groups = list(group_cols)
    part = corpus_part is not None
    q = queries.select(*groups, F.col(qid_col).cast("string").alias("qid"), as_double_array(vec_col).alias("vec"))
    c = corpus.select(
        *groups,
        *([F.col(corpus_part).cast("string").alias("part")] if part else []),
        F.col(did_col).cast("string").alias("did"),
        as_double_array(vec_col).alias("vec"),
    )
    n_groups = F.approx_count_distinct(F.struct(*groups)) if groups else F.max(F.lit(0))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), n_groups.alias("groups")).first()
    nq, dim = int(stats["n"]), int(stats["dim"] or 0)
    budget = conf_int(q.sparkSession, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES) if broadcast_bytes is None else broadcast_bytes
    if groups and nq * _row_bytes(dim) <= budget and stats["groups"] <= MAX_LOCAL_GROUPS:
        pairs = _pairs_broadcast_groups(_in_groups(q, groups), _in_groups(c, groups), groups, dim, query_block_bytes, part)
    elif groups:
        pairs = _pairs_streamed_groups(q, c, groups, dim, k, part) if stats["groups"] <= MAX_LOCAL_GROUPS else None
        pairs = _pairs_grouped(q, c, groups, dim, query_block_bytes, chunk_rows, part) if pairs is None else pairs
    else:
        pairs = _pairs_global(q, c, nq, dim, k, query_block_bytes, part, broadcast_bytes)
    types = {f.name: f.dataType.simpleString() for f in q.schema.fields}
    out_schema = ", ".join(
        [f"`{g}` {types[g]}" for g in groups] + (["part string"] if part else [])
        + ["qid string", "did string", "score double"]
    )
    partial = pairs.select(*groups, "blk", "q_items", "c_items").mapInArrow(
        _scorer(k, do_norm, exclude_identical, groups, part), out_schema
    )
    keys = [*groups, *(["part"] if part else []), "qid"]
    out = top_k(partial, k, keys=keys)
    if part and corpus_part != "part":
        out = out.withColumnRenamed("part", corpus_part)
    return out


@F.pandas_udf(DoubleType())
def _pair_scores(a: pd.Series, b: pd.Series, norm: pd.Series) -> pd.Series:
    """Cosine or dot products of aligned vectors, a batch at a time."""
    if not len(a):
        return pd.Series([], dtype=np.float64)
    la, lb = a.map(len).to_numpy(), b.map(len).to_numpy()
    if (la != lb).any():
        raise ValueError("vectors of a pair differ in length")
    out = np.empty(len(a))
    for dim in np.unique(la):
        at = np.flatnonzero(la == dim)
        x, y = (np.array(v.iloc[at].tolist(), dtype=np.float64).reshape(len(at), dim) for v in (a, b))
        if norm.iloc[0]:
            x, y = _normalise(x), _normalise(y)
        with np.errstate(invalid="ignore"):
            out[at] = np.einsum("ij,ij->i", x, y)
    return pd.Series(_settled(out, bool(norm.iloc[0])))


def score_pairs(
    pairs: DataFrame, q_vec: str = "q_vec", d_vec: str = "d_vec", do_norm: bool = True, out: str = "score"
) -> DataFrame:
    """Score already-joined (query, document) rows in Arrow batches (V2 on pairs, J4)."""
    return pairs.withColumn(out, _pair_scores(q_vec, d_vec, F.lit(do_norm)))
