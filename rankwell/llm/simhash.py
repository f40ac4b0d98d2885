"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks with thresholds that add up to
``distance - (blocks - 1)``: two fingerprints at most ``distance`` bits apart are
within its threshold in some block.  The anchors of a block are the words of a
covering code, a Hamming code of ``2**r - 1`` bits times all values of the other
bits: covering radius 1 (0 without a Hamming part).  A fingerprint is at home at
its nearest anchor and is replicated to every anchor within the covering radius
plus the block's threshold, so it meets each near fingerprint at that one's home.
At each anchor the home rows are compared with all rows there.

Equal fingerprints are one row beforehand, and an anchor gives a spanning forest
of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import documents, prepare, staged
from rankwell.llm.components import components

#: (first bit, bits, threshold, r of the Hamming part). Few replicas, about 2**18 anchors a block.
THREE_BLOCKS = ((0, 22, 1, 4), (22, 21, 1, 4), (43, 21, 0, 0))
#: Two blocks of 31 bits (two bits stay out): about 170 replicas, 2**26 anchors; for billions of fingerprints.
TWO_BLOCKS = ((0, 31, 2, 5), (31, 31, 1, 5))
#: Home rows of an anchor that one task takes; beyond it the anchor is split.
HOMES = 4096
#: Ids to drop that are sent to every task; with more, the rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 16


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, XXH64 of each shingle."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype=np.uint64).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(cast(text as string) as binary) as text").mapInArrow(run, "doc_id long, fp long")


@cache
def patterns(bits: int, radius: int, r: int) -> list[np.ndarray]:
    """By syndrome: the flips of at most ``radius`` bits that lead from a word with it to an anchor, nearest first."""
    ham = (1 << r) - 1 if r else 0
    by: list[list[int]] = [[] for _ in range(1 << r)]
    for weight in range(radius + 1):
        for flipped in combinations(range(bits), weight):
            s = 0
            for j in flipped:
                s ^= j + 1 if j < ham else 0
            by[s].append(sum(1 << j for j in flipped))
    return [np.array(x, dtype=np.int64) for x in by]


def replicate(fps: np.ndarray, layout=THREE_BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fp, home) of signed fingerprints; the anchor carries the block's number."""
    anchors, owners, homes = [], [], []
    u = fps.view(np.uint64)
    for no, (first, bits, threshold, r) in enumerate(layout):
        word = ((u >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = np.zeros(len(word), np.int64)
        for j in range((1 << r) - 1 if r else 0):
            syndrome ^= ((word >> j) & 1) * (j + 1)
        for s, flips in enumerate(patterns(bits, (1 if r else 0) + threshold, r)):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                anchors.append(((word[at, None] ^ flips[None, :]) | (no << 40)).ravel())
                owners.append(np.repeat(fps[at], len(flips)))
                homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    if not anchors:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(homes)


class _Links:
    """Spanning forest of the links found at one anchor: at most one edge per row, however dense the group."""

    def __init__(self, homes: np.ndarray, distance: int):
        self.homes, self.distance = homes, distance
        self.root = list(range(len(homes)))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, rows: np.ndarray) -> None:
        """Compare further rows of the anchor with its homes (an anchor where none is at home has no links to find)."""
        if not len(self.homes):
            return
        step = max(1, (1 << 21) // max(1, len(self.homes)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            near = np.bitwise_count((self.homes[:, None] ^ part[None, :]).view(np.uint64)) <= self.distance
            first = near.argmax(axis=0)
            hit = np.flatnonzero(near.any(axis=0) & (self.homes[first] != part))
            self.edges.append((self.homes[first[hit]], part[hit]))
            # Homes that share a row belong together; one edge for each union.
            h, c = np.nonzero(near)
            f = first[c]
            for x in np.unique((f.astype(np.int64) << 32 | h)[f != h]).tolist():
                p, q = self._find(x >> 32), self._find(x & 0xFFFFFFFF)
                if p != q:
                    self.root[max(p, q)] = min(p, q)

    def unions(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges between homes that meet in a shared row (they are in one component)."""
        roots = np.array([self._find(i) for i in range(len(self.homes))], dtype=np.int64)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return self.homes[moved], self.homes[roots[moved]]


def _pairs_of_small(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of sorted rows whose anchors hold few rows each: compare rows d places apart, for each d."""
    found, d = [], 1
    at = np.arange(len(anchor))
    while True:
        at = at[at < len(anchor) - d]
        at = at[anchor[at] == anchor[at + d]]
        if not len(at):
            return found
        a, b = fp[at], fp[at + d]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (home[at] | home[at + d]) & (a != b)
        found.append((a[near], b[near]))
        d += 1


def _compare(distance: int, small: int = 48):
    """Links of rows (anchor, fp, home) that come sorted by anchor, homes first; anchors may span batches."""

    def out(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 1]), pa.array(ab[:, 0])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, links = None, None  # a large anchor that may go on in the next batch
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)]
            cols = [np.concatenate([k, n]) for k, n in zip(kept, new)]
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            n = len(cols[0])
            cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
            if n and links is not None:  # go on with the open anchor
                if (cols[0][0], cols[1][0]) == open_key:
                    links.add(cols[2][: ends[0]])
                    starts, ends = starts[1:], ends[1:]
                if len(starts):
                    edges += [*links.edges, links.unions()]
                    links = None
                else:
                    edges += links.edges
                    links.edges = []
            if len(starts):
                sizes = ends - starts
                last = len(starts) - 1  # the last anchor may go on: keep its rows, or leave it open if large
                big = sizes > small
                for g in np.flatnonzero(big):
                    rows, home = cols[2][starts[g] : ends[g]], cols[3][starts[g] : ends[g]]
                    if g == last and home.all():
                        continue  # more homes may come: kept below
                    one = _Links(rows[home], distance)
                    one.add(rows)
                    if g == last:
                        open_key, links = (cols[0][starts[g]], cols[1][starts[g]]), one
                        edges += one.edges
                        one.edges = []
                    else:
                        edges += [*one.edges, one.unions()]
                keep_from = starts[last] if links is None else n
                little = np.repeat(~big, sizes)
                little[keep_from - starts[0] :] = False
                at = np.flatnonzero(little) + starts[0]
                key = np.repeat(np.arange(len(starts)), sizes)[at - starts[0]]
                edges += _pairs_of_small(key, cols[2][at], cols[3][at], distance)
                kept = [c[keep_from:] for c in cols]
            else:
                kept = [c[n:] for c in cols]
            if edges:
                yield out(edges)
        edges = [*links.edges, links.unions()] if links is not None else []
        if len(kept[0]):
            one = _Links(kept[2][kept[3]], distance)
            one.add(kept[2])
            edges += [*one.edges, one.unions()]
        if edges:
            yield out(edges)

    return run


def near_links(fps: DataFrame, distance: int = 4, layout=THREE_BLOCKS, homes_per_task: int = HOMES) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) linked at ``distance`` bits or fewer."""
    if sum(t for _, _, t, _ in layout) < distance - (len(layout) - 1):
        raise ValueError("the thresholds of the blocks do not cover the distance")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, fp, home = replicate(batch.column(0).to_numpy(), layout)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp), pa.array(home)], ["anchor", "fp", "home"])

    # Each row becomes a few dozen: deal them over as many tasks as later shuffles have.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").repartition(tasks, "fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    hot = rows.where("home").groupBy("anchor").count().where(F.col("count") > homes_per_task)
    hot = staged(hot.select(F.col("anchor").alias("h_anchor"), F.ceil(F.col("count") / homes_per_task).cast("int").alias("shares")), "simhash-hot")
    if hot.isEmpty():
        rows = rows.withColumn("share", F.lit(0).cast("long"))
    else:  # each share has a part of the homes, and all rows
        rows = rows.join(hot, F.col("anchor") == F.col("h_anchor"), "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)))
        rows = rows.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("shares")) == F.col("share")))
    rows = rows.select("anchor", "share", "fp", "home").repartition("anchor", "share").sortWithinPartitions("anchor", "share", F.col("home").desc())
    return rows.mapInArrow(_compare(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42, layout=THREE_BLOCKS, homes_per_task: int = HOMES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable through links, itself included).

    Null and empty texts have fingerprint zero and are linked like others; a null
    id never is the smallest unless all ids of the component are null.  Rows that
    repeat are all returned.
    """
    fps = staged(fingerprints(docs, shingle, seed), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts = components(near_links(distinct, distance, layout, homes_per_task))
    # Only linked fingerprints are in parts; the others are components of their own.
    linked = distinct.join(parts, F.col("fp") == F.col("node")).select("fp", "least", "component")
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "root")
    ids = linked.join(roots, F.col("component") == F.col("root")).select(F.col("fp").alias("c_fp"), "component_id")
    classes = distinct.join(ids, F.col("fp") == F.col("c_fp"), "left").select(F.col("fp").alias("k_fp"), F.coalesce("component_id", "least").alias("component_id"))
    classes = staged(classes, "simhash-classes")  # so that a fingerprint with very many rows is a join that Spark can split
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(classes, F.col("fp") == F.col("k_fp")).select("doc_id", hexed, "component_id")


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their columns.

    Rows that share an id go or stay together: they stay if one of them has the
    smallest id of its component.  Rows without an id stay if some component has
    no id at all.  Only the ids that go meet the rows.
    """
    found = near_duplicates(docs, **options)
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = staged(ids.where(~F.col("stays")).select(F.col("doc_id").alias("__gone")), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, links at 4 bits or fewer."""
    prepare(spark)
    return near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
