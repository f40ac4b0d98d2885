"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one representative beforehand.  A neighbour graph
starts from random-hyperplane buckets and is refined by local joins: at each
vector its neighbours and the vectors that list it are compared with each other,
until few links are gained.  Recall is audited with some vectors against all
others; if it is too low, buckets of new planes are added, and in the end the run
fails rather than return too few links.  Links are the graph's edges
at or over the threshold.  A list that is full of links is saturated: such lists
are enlarged to everything in their component, which is compared in blocks, so
that links are counted exactly in dense groups without emitting their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.llm.common import prepare, staged
from rankwell.llm.components import components
from rankwell.session import read_table

#: Length of neighbour lists, vectors per bucket of the first graph, tables of buckets.
K, LEAF, TABLES = 10, 32, 4
#: Rows that one task compares with each other at a time.
BLOCK = 512
#: Rows that a slice of a large group shares with the one before it.
SHARED = 16
#: True links that an audit should meet, vectors that it asks at most, times that tables are added, tables of a time at most.
ENOUGH, MOST, MORE, MAX_TABLES = 200, 16384, 4, 64


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    """Matrix of unit vectors in double precision from float32 bytes."""
    m = np.frombuffer(b"".join(vectors), dtype=np.float32).reshape(len(vectors), -1).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def comparable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the vector as bytes; null where it links with nothing.

    That is: null vector or label, zero vector, null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for label, vector in zip(batch.column(1), batch.column(2)):
                v = vector.values
                if not label.is_valid or v is None or not len(v) or v.null_count:
                    out.append(None)
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0 becomes 0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    return rows.selectExpr("cast(vec_id as long) as vec_id", "cast(label as string) as label", "cast(embedding as array<float>) as embedding").mapInArrow(run, "vec_id long, label string, vec binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups and the starts of these, from rows sorted by their first ``keys`` (integer) columns."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        cols = [table.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(max(0, len(table) - 1), bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new) + 1
        if not len(cuts):
            rest = table
            continue
        yield table.slice(0, cuts[-1]).combine_chunks().to_batches()[0], np.concatenate([[0], cuts[:-1]])
        rest = table.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest.combine_chunks().to_batches()[0], np.zeros(1, np.int64)


def _best(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> pa.RecordBatch:
    """Rows (u, v, c): for each u its k best of the pairs, taken in both directions."""
    u, v, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    again = np.concatenate([[False], (u[1:] == u[:-1]) & (v[1:] == v[:-1])])
    u, v, s = u[~again], v[~again], s[~again]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    first = np.searchsorted(u, u)
    keep = np.arange(len(u)) - first < k
    return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep]), pa.array(s[keep])], ["u", "v", "c"])


def _chain(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that connect what the links of a block connect, with at most two of them a row."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        if (least == label).all():
            break
        label = least
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return order[:-1][same], order[1:][same]


def _join_groups(keys: int, k: int, threshold: float | None = None):
    """All pairs within groups of rows (keys..., rid, vec), in blocks; for each row its k best.

    With a threshold also rows without c: they connect all rows of a block that its
    links connect, as lists full of closer ones drop the links to the rest of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, keys):
            rid = batch.column(keys).to_numpy()
            vecs = batch.column(keys + 1).to_pylist()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            chains: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, [*starts[1:], len(rid)]):
                for i in range(s, e, BLOCK // 2):
                    # Slices share rows, so that the links of a group that fills several connect.
                    part = slice(max(s, i - SHARED), min(e, i + BLOCK // 2))
                    n = part.stop - part.start
                    if n < 2:
                        continue
                    m = unit_rows(vecs[part])
                    sim = m @ m.T
                    np.fill_diagonal(sim, -2)
                    kk = min(k, n - 1)
                    top = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
                    found.append((np.repeat(rid[part], kk), rid[part][top].ravel(), np.take_along_axis(sim, top, axis=1).ravel()))
                    if threshold is not None and (near := sim >= threshold).any():
                        chains.append(tuple(rid[part][x] for x in _chain(near)))
            if chains:
                a, b = (np.concatenate(x) for x in zip(*chains))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.float64())], ["u", "v", "c"])
            if found:
                a, b, c = (np.concatenate(x) for x in zip(*found))
                differ = a != b
                yield _best(a[differ], b[differ], c[differ], k)

    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each vector, and the rows without c, which only connect."""
    best = Window.partitionBy("u").orderBy(F.col("c").desc_nulls_last(), "v")
    once = edges.groupBy("u", "v", F.col("c").isNull()).agg(F.max("c").alias("c"))
    return once.withColumn("n", F.row_number().over(best)).where((F.col("n") <= k) | F.col("c").isNull()).select("u", "v", "c")


def tables_for(bits: int, threshold: float, recall: float, least: int = TABLES) -> int:
    """Tables of buckets of so many bits that have a pair at the threshold together at least once with probability ``recall``."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    if together >= 1:
        return least
    return int(min(MAX_TABLES, max(least, np.ceil(np.log(1 - recall) / np.log1p(-together))))) if together > 0 else MAX_TABLES


def first_graph(reps: DataFrame, k: int = K, leaf: int = LEAF, tables: int = TABLES, seed: int = 5, threshold: float | None = None, recall: float = 0.995) -> DataFrame:
    """Lists from buckets of equal signs on random hyperplanes, about ``leaf`` vectors in each.

    With a threshold the number of tables grows with the bits, so that pairs without other neighbours are found.
    """
    need = np.array([tables if threshold is None else tables_for(b, threshold, recall, tables) for b in range(31)])
    sizes = reps.groupBy("label", F.length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    sizes = sizes.select(F.col("label").alias("s_label"), F.col("bytes").alias("s_bytes"), bits.alias("bits"))
    rows = reps.join(sizes, (F.col("label") == F.col("s_label")) & (F.length("vec") == F.col("s_bytes")))
    rows = rows.select("rid", F.xxhash64("label", "s_bytes").alias("part"), "bits", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rid, part, bits = (batch.column(i).to_numpy() for i in range(3))
            vecs = batch.column(3).to_pylist()
            dims = np.array([len(v) // 4 for v in vecs])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = unit_rows([vecs[i] for i in at])
                for t in range(need[bits[at]].max()):
                    if (t, d) not in planes:
                        planes[t, d] = np.random.default_rng([seed, t, int(d)]).standard_normal((d, 30))
                    here = np.flatnonzero(need[bits[at]] > t)
                    rows = at[here]
                    signs = (m[here] @ planes[t, d] > 0) & (np.arange(30) < bits[rows, None])
                    code = (signs << np.arange(30, dtype=np.int64)).sum(axis=1) | (t << 40)
                    key = (part[rows] * 31 + code) * np.int64(-7046029254386353131) ^ code
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rid[rows]), pa.array([vecs[i] for i in rows], pa.binary())], ["key", "rid", "vec"])

    keyed = rows.mapInArrow(run, "key long, rid long, vec binary")
    # The key is another one in each table, and so is the order in which large buckets are sliced.
    grouped = keyed.repartition("key").sortWithinPartitions("key", F.xxhash64("rid", "key"))
    return _lists(grouped.mapInArrow(_join_groups(1, k, threshold), "u long, v long, c double"), k)


def refine(graph: DataFrame, reps: DataFrame, k: int, round_no: int, threshold: float | None = None) -> DataFrame:
    """One local join: neighbours and listing vectors of each vector are compared with each other.

    Long lists of listing vectors are dealt into shares by a hash that changes every round.
    """
    listed = graph.where("c is not null")
    both = listed.select(F.col("u").alias("w"), F.col("v").alias("m")).union(listed.select(F.col("v").alias("w"), F.col("u").alias("m"))).distinct()
    degree = listed.groupBy(F.col("v").alias("d_w")).count()
    both = both.join(degree, F.col("w") == F.col("d_w"), "left")
    shares = F.ceil((F.coalesce("count", F.lit(0)) + k) / (6 * k)).cast("long")
    both = both.select("w", F.pmod(F.xxhash64("m", F.lit(round_no)), shares).alias("share"), "m")
    rows = both.join(reps.select("rid", "vec"), F.col("m") == F.col("rid")).select("w", "share", "rid", "vec")
    rows = rows.repartition("w", "share").sortWithinPartitions("w", "share", F.xxhash64("rid", F.lit(round_no)))
    found = rows.mapInArrow(_join_groups(2, k, threshold), "u long, v long, c double")
    return _lists(found.union(graph), k)


def audit(reps: DataFrame, links: DataFrame, threshold: float, n_queries: int = 256) -> tuple[float, int]:
    """(recall, true links) of ``n_queries`` vectors, the first by a hash of their number, against all vectors."""
    queries = reps.orderBy(F.xxhash64("rid"), "rid").limit(n_queries).select("rid", "label", "vec").collect()
    by: dict[tuple[str, int], list] = {}
    for q in queries:
        by.setdefault((q["label"], len(q["vec"])), []).append(q)
    blocks = {key: (np.array([q["rid"] for q in qs]), unit_rows([bytes(q["vec"]) for q in qs])) for key, qs in by.items()}
    shared = reps.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vecs, rid = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_numpy()
            total = 0
            for (label, size), (ids, m) in shared.value.items():
                at = [i for i, (x, v) in enumerate(zip(labels, vecs)) if x == label and len(v) == size]
                step = max(1, (1 << 22) // len(ids))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    total += int(((unit_rows([vecs[i] for i in some]) @ m.T >= threshold) & (rid[some][:, None] != ids[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    true = reps.select("rid", "label", "vec").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    asked = reps.sparkSession.createDataFrame([(q["rid"],) for q in queries], "q long")
    found = links.join(F.broadcast(asked), F.col("rid") == F.col("q")).agg(F.sum("near")).first()[0] or 0
    return (found / true if true else 1.0), true


def audit_enough(reps: DataFrame, links: DataFrame, threshold: float, total: int) -> tuple[float, int]:
    """An audit of so many vectors that it meets ``ENOUGH`` true links, if ``MOST`` vectors have them."""
    n = 256
    while True:
        recall, true = audit(reps, links, threshold, n)
        if true >= ENOUGH or n >= min(total, MOST):
            return recall, true
        n = min(8 * n, MOST)


def _count_block(threshold: float):
    """Links within and between two blocks of a component: (rid, near, weight) per row, no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, 3):
            i, j, side = (batch.column(c).to_numpy() for c in (1, 2, 3))
            rid, n, vecs = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, [*starts[1:], len(rid)]):
                left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                same = i[s] == j[s]
                if same:
                    right = left
                if not len(left) or not len(right):
                    continue
                near = unit_rows([vecs[x] for x in left]) @ unit_rows([vecs[x] for x in right]).T >= threshold
                near &= rid[left][:, None] != rid[right][None, :]
                out.append((rid[left], near.sum(axis=1), near @ n[right]))
                if not same:
                    out.append((rid[right], near.sum(axis=0), near.T @ n[left]))
            if out:
                a, b, c = (np.concatenate(x).astype(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["rid", "near", "weight"])

    return run


def _links(graph: DataFrame, reps: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(rid, near, weight) of linked vectors, and (node, component): lists full of links are enlarged to their component."""
    directed = graph.where(F.col("c") >= threshold).select("u", "v")
    both = directed.union(directed.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = staged(both, "vectors-links")
    connected = both.union(graph.where("c is null").select("u", "v"))
    parts = staged(components(connected.select(F.col("u").alias("a"), F.col("v").alias("b"))), "vectors-parts")
    weights = reps.select(F.col("rid").alias("w_rid"), "n")
    listed = both.join(weights, F.col("v") == F.col("w_rid")).groupBy(F.col("u").alias("rid")).agg(F.count(F.lit(1)).alias("near"), F.sum("n").alias("weight"))
    full = directed.groupBy("u").count().where(F.col("count") >= k).select("u")
    dense = parts.join(full, F.col("node") == F.col("u"), "left_semi").select(F.col("component").alias("d_part")).distinct()
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(dense, F.col("component") == F.col("d_part"), "left_semi")
    sizes = sizes.select(F.col("component").alias("s_part"), F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    members = parts.join(sizes, F.col("component") == F.col("s_part")).join(reps.select("rid", "n", "vec"), F.col("node") == F.col("rid"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = members.select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rid", "n", "vec"
    ).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = tiles.mapInArrow(_count_block(threshold), "rid long, near long, weight long").groupBy("rid").agg(F.sum("near").alias("near"), F.sum("weight").alias("weight"))
    in_dense = parts.join(dense, F.col("component") == F.col("d_part"), "left_semi").select(F.col("node").alias("m_rid"))
    sparse = listed.join(in_dense, F.col("rid") == F.col("m_rid"), "left_anti")
    return staged(sparse.unionByName(counted), "vectors-counts"), parts


def near_duplicates(rows: DataFrame, threshold: float = 0.98, k: int = K, max_rounds: int = 6, settled: float = 0.01, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Only rows with equal non-null labels and vectors of one length are compared.
    ``n_links`` counts the other rows linked directly, equal ones included;
    ``component_id`` is the smallest vec_id reachable; ``kept`` says that the
    row has it.  Rows that link with nothing are components of their own.
    Repeated ids each count as a row; an empty table gives no rows.
    """
    base = staged(comparable(rows), "vectors")
    reps = base.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    reps = staged(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors-distinct")
    total = reps.count()
    graph = staged(first_graph(reps, k, threshold=threshold, recall=recall), "vectors-graph")
    round_no = 0
    for more in range(MORE + 1):
        if more:
            graph = staged(_lists(first_graph(reps, k, seed=5 + more, threshold=threshold, recall=recall).union(graph), k), "vectors-graph")
        for _ in range(max_rounds):
            round_no += 1
            new = staged(refine(graph, reps, k, round_no, threshold), "vectors-graph")
            old = graph.where("c is not null").select(F.col("u").alias("o_u"), F.col("v").alias("o_v"), F.lit(1).alias("old"))
            edges = new.where("c is not null").join(old, (F.col("u") == F.col("o_u")) & (F.col("v") == F.col("o_v")), "left")
            # What matters is whether lists still gain links, or entries near the threshold.
            gains = [(F.count(F.when(c, 1)), F.count(F.when(c & F.col("old").isNull(), 1))) for c in (F.col("c") >= threshold, F.col("c") >= threshold - 0.1)]
            links, gained, near, came = edges.agg(*[x.alias(f"n{i}") for i, x in enumerate(sum(gains, ()))]).first()
            graph = new
            if gained <= settled * links and came <= settled * near:
                break
        counts, parts = _links(graph, reps, threshold, k)
        last, true = audit_enough(reps, counts, threshold, total)
        if last >= recall:
            break
    else:
        raise RuntimeError(f"near_duplicates: recall {last:.4f} of {true} true links is under {recall} after {round_no} rounds")
    classes = reps.select(F.col("rid"), "label", "vec", "least", "n")
    found = counts.select(F.col("rid").alias("f_rid"), "weight")
    classes = classes.join(found, F.col("rid") == F.col("f_rid"), "left").join(parts.withColumnRenamed("node", "p_rid"), F.col("rid") == F.col("p_rid"), "left")
    classes = classes.select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), "least", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", F.col("rid")).alias("part"))
    classes = staged(classes, "vectors-classes")
    roots = classes.groupBy(F.col("part").alias("r_part")).agg(F.min("least").alias("component_id"))
    classes = classes.join(roots, F.col("part") == F.col("r_part")).select("c_label", "c_vec", "n_links", "component_id")
    out = base.join(classes, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left")
    component = F.when(F.col("c_vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings within their labels, cosine 0.98 or more."""
    prepare(spark)
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id
"""
