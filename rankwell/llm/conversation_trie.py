"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Conversations are ordered by turn and rebuilt: the first turns of their family's
conversation, then their own.  Every sequence of first turns is a node.

*   **Node keys** are polynomial hashes of turn digests modulo two primes.  Such a
    hash of a sequence follows from those of its parts, so one distributed sort
    orders all turns, every task hashes its own rows, and what a conversation
    brings over from the task before is added afterwards.  No conversation, however
    long, is one group of a task, and rebuilding needs no second sort.
*   **Subtree totals**: rounds of *rake* (leaves add their totals to their parents
    and go) and *compress* (of a chain of nodes with one child each, nodes that are
    not neighbours go; their totals move to the edge below them).  A trie of n nodes
    is gone after about log n rounds, also if it is one long chain.  Then the
    compressed nodes come back in reverse order: each adds what it kept to the
    total of the node below it.

Groups never collect rows: children are added up with partial aggregation, keys
with many rows meet their lookup row by a broadcast of a proven size
(``common.lookup_join``), and the lists of ids under a digest are written in
sorted chunks by all tasks before one task per node reads the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import lookup_join, prepare, staged
from rankwell.session import read_table

#: Moduli and bases of the two hashes of a sequence (fixed values; any primes and large bases do).
PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (1_099_511_628_211_777_773, 1_610_612_741_402_653_189)
#: Conversations of one family, and the remainder that bounds how many turns they share.
FAMILY, SHARED = 100, 6
#: Characters of a chunk of ids under a digest.
CHUNK = 1 << 16
#: Depth bits that take turns in choosing which nodes of a chain go.
BITS = 24


# ---------------------------------------------------------------- hashes of first turns
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: place and hash of the turn's sequence, counted from the partition's start."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    (p, q), (u, v) = PRIMES, BASES
    held = None
    conv, i, a, b = None, 0, 0, 0

    def flush(rows, last):
        end = [False] * len(rows)
        end[-1] = last
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in cols), pa.array(end)],
            names=["pid", "conv_id", "i", "a", "b", "ua", "ub", "chars", "last"])

    for batch in batches:
        rows = []
        for c, digest, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "digest", "chars"))):
            if c != conv:
                conv, i, a, b = c, 0, 0, 0
            before = (a, b)
            a = (a * u + int(digest[:15], 16) + 1) % p
            b = (b * v + int(digest[15:30], 16) + 1) % q
            rows.append((c, i, a, b, *before, chars))
            i += 1
        if rows:
            if held:
                yield flush(held, False)
            held = rows
    if held:
        yield flush(held, True)


def _carried(tails: list) -> dict[int, tuple[int, int, int, int]]:
    """What the first conversation of a partition has had before: (conv_id, turns, hash, hash) by partition.

    ``tails`` has one row per partition: its last conversation so far.
    """
    carry, state = {}, None
    for t in sorted(tails, key=lambda t: t["pid"]):
        n, a, b = t["i"] + 1, t["a"], t["b"]
        if state is not None:
            carry[t["pid"]] = state
            if state[0] == t["conv_id"]:  # the whole partition is a part of it
                a = (state[2] * pow(BASES[0], n, PRIMES[0]) + a) % PRIMES[0]
                b = (state[3] * pow(BASES[1], n, PRIMES[1]) + b) % PRIMES[1]
                n += state[1]
        state = (t["conv_id"], n, a, b)
    return carry


def _continued(carry: dict):
    """Adds what was before to rows of conversations that began in an earlier partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p, q), (u, v) = PRIMES, BASES
        for batch in batches:
            rows = []
            for pid, conv, i, a, b, ua, ub, chars in zip(*(c.to_pylist() for c in batch.columns)):
                _, n, x, y = carry[pid]
                xi, yi = x * pow(u, i, p), y * pow(v, i, q)
                rows.append((pid, conv, i + n, (xi * u + a) % p, (yi * v + b) % q, (xi + ua) % p, (yi + ub) % q, chars))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=batch.schema.names)

    return run


def first_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, ua, ub, chars): place of every turn, hashes of the turns up to it and before it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.where(F.col("conv_id").isNotNull())
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("digest", digest).withColumn("chars", F.length("text").cast("long"))
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "digest", "chars")
    schema = "pid int, conv_id long, i long, a long, b long, ua long, ub long, chars long"
    numbered = staged(ordered.mapInArrow(_number, schema + ", last boolean"), "trie-turns")
    carry = _carried(numbered.where("last").select("pid", "conv_id", "i", "a", "b").collect())  # one row per partition
    rows = numbered.drop("last")
    if carry:
        crossing = rows.sparkSession.createDataFrame([(pid, state[0]) for pid, state in carry.items()], "pid int, conv_id long")
        later = rows.join(F.broadcast(crossing), ["pid", "conv_id"]).select(*rows.columns)
        rows = rows.join(F.broadcast(crossing), ["pid", "conv_id"], "left_anti").unionByName(later.mapInArrow(_continued(carry), schema))
    return rows.drop("pid")


# ---------------------------------------------------------------- rebuilt conversations
def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of own turns behind the shared ones instead of behind the conversation's own first turns.

    If D is the hash of the shared turns less that of the turns they replace, the
    hash after e own turns is D * base ** e more than before.
    """
    (p, q), (u, v) = PRIMES, BASES
    powers = [(pow(u, e, p), pow(v, e, q)) for e in range(1024)]
    for batch in batches:
        rows = []
        for conv, depth, e, a, b, ua, ub, da, db, chars, end in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = powers[e - 1] if e <= 1024 else (pow(u, e - 1, p), pow(v, e - 1, q))
            x, y = da * x, db * y
            rows.append((conv, depth, (x * u + a) % p, (y * v + b) % q, (x + ua) % p, (y + ub) % q, chars, end))
        cols = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.bool_())], names=["conv_id", "depth", "a", "b", "pa", "pb", "chars", "ends"])


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars, ends): every rebuilt conversation at each of its nodes, the root included."""
    rows = first_turns(turns)
    at = [F.max(F.when(F.col("i") == j, F.col(c))).alias(f"{c}{j + 1}") for j in range(SHARED - 1) for c in ("a", "b", "chars")]
    convs = rows.groupBy("conv_id").agg((F.max("i") + 1).alias("n"), *at)
    convs = staged(convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED), "trie-convs")
    heads = ["n", *(f"{c}{j}" for j in range(1, SHARED) for c in ("a", "b", "chars"))]
    base = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), *(F.col(c).alias(f"base_{c}") for c in heads))
    # a family has fewer than 2 * FAMILY conversations, so this key is never hot
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("own", F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def hash_at(prefix: str, c: str, n: Column) -> Column:
        """Hash of the first n turns (0 if n is 0)."""
        out = F.lit(0).cast("long")
        for j in range(1, SHARED):
            out = F.when(n == j, F.col(f"{prefix}{c}{j}")).otherwise(out)
        return out

    steps = [F.struct(F.lit(j).cast("long").alias("depth"), *(F.col(f"base_{c}{j}").alias(c) for c in ("a", "b")),
                      *((F.col(f"base_{c}{j - 1}") if j > 1 else F.lit(0).cast("long")).alias(f"p{c}") for c in ("a", "b")),
                      F.col(f"base_chars{j}").alias("chars")) for j in range(1, SHARED)]
    no = F.lit(None).cast("long")
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
                    no.alias("pa"), no.alias("pb"), F.lit(0).cast("long").alias("chars"))
    shared = convs.select("conv_id", "own", "m", F.explode(F.slice(F.array(root, *steps), 1, (F.col("m") + 1).cast("int"))).alias("s"))
    shared = shared.select("conv_id", "s.*", ((F.col("own") == 0) & (F.col("s.depth") == F.col("m"))).alias("ends"))

    moved = [((hash_at("base_", c, F.col("m")) - hash_at("", c, F.col("h"))) % p).alias(f"d{c}") for c, p in zip("ab", PRIMES)]
    info = convs.where("own > 0").select("conv_id", "n", "h", "m", *moved)
    own = lookup_join(rows, info, ["conv_id"], "n").where("i >= h")
    own = own.select("conv_id", (F.col("m") + F.col("i") - F.col("h") + 1).alias("depth"), (F.col("i") - F.col("h") + 1).alias("e"),
                     "a", "b", "ua", "ub", "da", "db", "chars", (F.col("i") == F.col("n") - 1).alias("ends"))
    own = own.mapInArrow(_moved, "conv_id long, depth long, a long, b long, pa long, pb long, chars long, ends boolean")
    return shared.unionByName(own)


# ---------------------------------------------------------------- contraction
KEY = ["a", "b"]


def _bare(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


def contract(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node -> (a, b, *values).

    ``nodes`` has (a, b, pa, pb, depth, kids, *values): key, parent's key (null for
    the root), depth and number of children of every node of one tree.  Each round
    reads the tree of the round before from a table in the shared folder.
    """
    edge = [f"edge_{x}" for x in values]
    live = staged(nodes.select(*KEY, "pa", "pb", "depth", "kids", *values, *(F.lit(0).cast("long").alias(e) for e in edge)), "trie-live")
    is_root = F.col("pa").isNull()
    done: list[DataFrame] = []
    gone: list[DataFrame] = []
    for number in range(10_000):
        if live.limit(1).count() == 0:
            break
        raked = (F.col("kids") == 0)
        done.append(live.where(raked).select(*KEY, *values))
        # rake: one row per parent, whatever the number of its children
        up = live.where(~is_root).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.count(F.when(raked, 1)).alias("raked"), *(F.sum(F.when(raked, F.col(x) + F.col(e))).alias(f"up_{x}") for x, e in zip(values, edge)),
            *(F.max(F.when(~raked, F.col(k))).alias(f"c{k}") for k in KEY))
        added = [(F.col(x) + F.coalesce(f"up_{x}", F.lit(0))).alias(x) for x in values]
        rest = live.where(~raked).join(up, KEY, "left").select(*KEY, "pa", "pb", "depth", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"), *added, *edge, "ca", "cb")
        # compress: nodes with one child, by a bit of their depth, whose child is no such node
        turn = F.shiftright("depth", number % BITS).bitwiseAND(F.lit(1)) == 1
        rest = staged(rest.withColumn("picked", ~is_root & (F.col("kids") == 1) & turn), "trie-rest")
        above = _bare(rest.where("picked"), "v_", [*KEY, "pa", "pb", *values, *edge, "ca", "cb"])
        met = rest.join(above, (F.col("a") == F.col("v_ca")) & (F.col("b") == F.col("v_cb")) & ~F.col("picked"), "left")
        met = staged(met.drop("v_ca", "v_cb", "ca", "cb", "picked"), "trie-met")
        spliced = met.where(F.col("v_a").isNotNull())
        # the total of a node that goes is that of its child and what lay on and above the edge between them
        gone.append(spliced.select(F.col("v_a").alias("a"), F.col("v_b").alias("b"), F.col("a").alias("ca"), F.col("b").alias("cb"), *((F.col(f"v_{x}") + F.col(e)).alias(x) for x, e in zip(values, edge))))
        new = F.col("v_a").isNotNull()
        kept = met.join(spliced.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")), KEY, "left_anti")
        live = staged(kept.select(
            *KEY, F.when(new, F.col("v_pa")).otherwise(F.col("pa")).alias("pa"), F.when(new, F.col("v_pb")).otherwise(F.col("pb")).alias("pb"), "depth", "kids", *values,
            *((F.col(e) + F.when(new, F.col(f"v_{x}") + F.col(f"v_{e}")).otherwise(F.lit(0))).alias(e) for x, e in zip(values, edge))), "trie-live")
    else:
        raise RuntimeError("the tree did not contract: its parents do not form a tree")
    total = done[0] if done else nodes.select(*KEY, *values)
    for more in done[1:]:
        total = total.unionByName(more)
    # re-expansion, last round first: the node below is known by then
    for table in reversed(gone):
        if table.limit(1).count():
            below = _bare(total, "c_", [*KEY, *values])
            back = table.join(below, (F.col("ca") == F.col("c_a")) & (F.col("cb") == F.col("c_b")))
            back = staged(back.select(*KEY, *((F.col(x) + F.col(f"c_{x}")).alias(x) for x in values)), "trie-back")
            total = total.unionByName(back)
    return total


# ---------------------------------------------------------------- digests of the ids that end at a node
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) rows -> comma-joined ids in chunks, with the first id of each."""
    key, ids, size = None, [], 0
    out: list[tuple] = []

    def pack():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (key != (a, b) or size >= CHUNK):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            key = (a, b)
            ids.append(conv)
            size += len(str(conv)) + 1
        if len(out) >= 1000:
            yield pack()
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield pack()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> SHA-256 of each node's ids; one chunk at a time is in memory."""
    key, sha = None, None
    out: list[tuple] = []

    def pack():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == (a, b):
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 1000:
            yield pack()
    if key is not None:
        out.append((*key, sha.hexdigest()))
    if out:
        yield pack()


def end_digests(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the ids of (a, b, conv_id) rows, ascending.  All tasks sort and write the lists."""
    chunks = rows.select(*KEY, "conv_id").orderBy(*KEY, "conv_id").mapInArrow(_chunks, "a long, b long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has (conv_id, turn, role, text).  Turns are ordered by turn, nulls
    first, equal ones by role and text; a null role or text is empty; rows without
    a conv_id belong to no conversation.  Repeated rows are turns of their own.  A
    table without conversations has no nodes, not even the root.
    """
    rows = staged(members(turns), "trie-members")
    nodes = rows.groupBy(*KEY).agg(
        F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = staged(nodes, "trie-nodes")
    kids = nodes.where(F.col("pa").isNotNull()).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    weight = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    nodes = staged(nodes.select("*", (F.col("kids") == 0).cast("long").alias("n_leaves"), weight), "trie-tree")
    totals = contract(nodes, ["n_leaves", "saved_tokens"])
    own = nodes.select(*KEY, "pa", "pb", "conv_id", "depth", "n_convs", F.col("kids").alias("n_children"))
    parents = nodes.where("kids > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "kids")
    named = lookup_join(own.where(F.col("pa").isNotNull()), parents, ["pa", "pb"], "kids").drop("kids")
    named = named.unionByName(own.where(F.col("pa").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(totals, KEY).join(end_digests(rows.where("ends")), KEY, "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``."""
    prepare(spark)
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, max(i) AS n, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda s, y: list_reduce(list_concat([xor(s, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))),
             4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY conv_id),
cm AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
turns AS (
  SELECT cm.conv_id, t.i AS d, t.role, t.text FROM cm JOIN t ON t.conv_id = cm.base AND t.i <= cm.h
  UNION ALL
  SELECT cm.conv_id, cm.m + t.i - cm.h, t.role, t.text FROM cm JOIN t ON t.conv_id = cm.conv_id AND t.i > cm.h),
mem AS (
  SELECT conv_id, d, length(text) AS chars,
         string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(d) AS total FROM mem GROUP BY conv_id),
node AS (
  SELECT k, any_value(d) AS d, min(mem.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS w,
         sha256(coalesce(string_agg(mem.conv_id::VARCHAR, ',' ORDER BY mem.conv_id) FILTER (d = total), '')) AS ends_sha256
  FROM mem JOIN len USING (conv_id) GROUP BY k),
kid AS (SELECT left(k, (length(k) - 32)::BIGINT) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sub AS (
  SELECT mem.k, sum(y.w)::BIGINT AS saved_tokens, count(*) FILTER (kid.n IS NULL) AS n_leaves
  FROM node y LEFT JOIN kid ON kid.k = y.k JOIN mem ON mem.conv_id = y.conv_id AND mem.d <= y.d GROUP BY mem.k)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kid.n, 0) AS n_children, sub.n_leaves, sub.saved_tokens, x.ends_sha256
FROM node x JOIN sub ON sub.k = x.k LEFT JOIN kid ON kid.k = x.k LEFT JOIN node p ON x.d > 0 AND p.k = left(x.k, (length(x.k) - 32)::BIGINT)
"""
