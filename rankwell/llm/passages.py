"""Repeated passages across documents: MinHash banding over content-defined paragraphs.

A passage may stand anywhere, also inside a line, so paragraphs are windows of
``WORDS`` words.  They begin at a text's start, at the start of every line of
``WORDS`` words or more, ``WORDS`` words before a text's end, and at winnowed
anchors: of every ``REACH`` three-word hashes in a row the least is one.  A
passage of ``WORDS + REACH - 1`` words or more thus has an anchor of its own that
every copy has.  A digest of the ``BEHIND`` words behind a paragraph tells whether
a copy goes on like the first one, so that the stretch to the next anchor counts.

Equal paragraphs are grouped by digest with partial aggregation.  For near ones,
each half of a paragraph is a band of three MinHash values over its five-word
shingles: whatever one word is replaced, the other half still collides.  Colliding
paragraphs are verified exactly, and are near if either

* their edit distance is one replaced, inserted or left-out word: both have the
  same words left after some deletion of one; or
* the Jaccard similarity of their shingles (repeats numbered) is 0.8 or more:
  of n shingles each, at most k are missing in the other, so both have the same
  set left after some deletion of k.  Of 12 shingles one may be missing; if it is
  not at an end, the rest can only stand in another order, which needs three words
  that stand twice.  Only paragraphs with such words need this second form.

The hashes of what is left are joined by equality, which costs a fixed number of
rows per paragraph even if thousands collide; no pairs are enumerated.
Classes are connected components; the first paragraph of a class stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.llm.common import documents, prepare, staged
from rankwell.llm.components import components

#: Words of a paragraph, hashes in a row of which the least is an anchor, words of a shingle.
WORDS, REACH, SHINGLE = 16, 36, 5
#: Words behind a paragraph that are compared, too, so that it reaches the next anchor.
BEHIND = REACH - WORDS
SIMILARITY = 0.8
#: Multipliers of the MinHash functions.
_FUNCTIONS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _along(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row along the last axis."""
    size = h.shape[-1] - n + 1
    out = h[..., :size].copy()
    for i in range(1, n):
        out = _mix(out * np.uint64(3) + h[..., i : size + i])
    return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row; none if there are fewer."""
    return _along(h, n) if len(h) >= n else h[:0]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


#: Bytes of the texts that are taken apart together, and paragraphs that are keyed together: arrays of that size stay in the cache.
GROUP_BYTES, GROUP_PARAGRAPHS = 1 << 20, 1 << 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lower-cased texts) of runs of about ``GROUP_BYTES``; null is empty."""
    group, size, first = [], 0, 0
    for i, text in enumerate(column):
        data = (text.as_py() or b"").lower()
        group.append(data)
        size += len(data)
        if size >= GROUP_BYTES:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def word_table(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, start, stop) of the words of all texts, (first word, words) of each text, the same of each line.

    ``start`` and ``stop`` are bytes of the word's own text.  Equal words are hashed once.
    """
    joined = b"\n".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes + 1) - sizes - 1  # of each text in ``joined``
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    first = np.searchsorted(start, offset)
    lines = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    line = np.searchsorted(start, lines)
    bounds = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    letters = raw[inside[1:-1]]
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    h = word_hashes(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(start) else np.zeros(0, np.uint64)
    counts = np.diff(np.concatenate([first, [len(start)]]))
    own = np.repeat(offset, counts)
    return h, start - own, stop - own, first, counts, line, np.diff(np.concatenate([line, [len(start)]]))


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (least or greatest) of every n values in a row, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = pick(x[:-step], x[step:])
        size += step
    return x


def anchors(h: np.ndarray, reach: int = REACH, first: np.ndarray | None = None) -> np.ndarray:
    """Positions whose three-word hash is the least of some ``reach`` hashes in a row.

    ``first`` are the first words of the texts that ``h`` holds one after the other (by default it is one text).
    Of equal ones less than ``reach`` apart only the first is kept, so repeated words do not make every position one.
    """
    if len(h) < reach + 2:
        return np.zeros(0, np.int64)
    first = np.zeros(1, np.int64) if first is None else first
    end = np.repeat(np.append(first[1:], len(h)), np.diff(np.append(first, len(h))))  # of the text of each word
    g = _runs(h, 3)
    least = _sliding(g, reach, np.minimum)
    inside = np.arange(len(least)) + reach + 2 <= end[: len(least)]  # windows of one text
    least = np.where(inside, least, np.uint64(0))
    # A position lies in up to ``reach`` windows; it is the least of one if the greatest of their least values is its own.
    none = np.zeros(reach - 1, np.uint64)
    lies = np.flatnonzero(g == _sliding(np.concatenate([none, least, none]), reach, np.maximum))
    lies = lies[lies + 3 <= end[lies]]
    text = np.searchsorted(first, lies, "right") - 1
    at = lies[(end[lies] - first[text]) >= reach + 2]
    owner = end[at]
    same = (g[at[1:]] == g[at[:-1]]) & (owner[1:] == owner[:-1])
    if not same.any():
        return at
    keep = np.ones(len(at), bool)
    for i in np.unique(owner[1:][same]).tolist():  # texts with equal ones in a row
        lo, hi = np.searchsorted(owner, [i, i + 1])
        last = at[lo]
        for j in range(lo + 1, hi):
            keep[j] = g[at[j]] != g[last] or at[j] - last >= reach
            if keep[j]:
                last = at[j]
    return at[keep]


def text_paragraphs(texts: list[bytes], words_n: int = WORDS, reach: int = REACH) -> tuple[np.ndarray, ...] | None:
    """(text, first word, first byte, end byte, digest, words behind, their end byte, their digest, band values...) of
    each paragraph of lower-cased texts, in order; None if there is none.

    Up to ``BEHIND`` words behind a paragraph count.  Words are runs between ASCII white space; line breaks count as white space.
    """
    h, start, stop, first, counts, line, line_words = word_table(texts)
    long = counts >= words_n
    if not long.any():
        return None
    end = first + counts
    heads = line[line_words >= words_n]
    at = np.unique(np.concatenate([anchors(h, reach, first), heads, first[long], end[long] - words_n]))
    text = np.searchsorted(first, at, "right") - 1  # of several texts that begin there all but the last are empty
    fits = at + words_n <= end[text]
    at, text = at[fits], text[fits]
    end = end[text]
    shingles = _runs(h, SHINGLE)
    half = words_n // 2
    digest = _runs(h, words_n)[at]
    bands = np.zeros((2, len(at)), np.uint64)
    bands[1] = _MIX  # a first half never meets a second one
    for m in _FUNCTIONS:
        least = _sliding(_mix(shingles * np.uint64(m)), half - SHINGLE + 1, np.minimum)
        bands = _mix(bands * np.uint64(3) + np.stack([least[at], least[at + words_n - half]]))
    behind = np.minimum(BEHIND, end - at - words_n)
    # Zeros stand for the words missing at the end of a text.
    place = (at + words_n)[:, None] + np.arange(BEHIND)
    following = np.where(place < end[:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
    tail = _along(following, BEHIND)[:, 0]
    return (text, at - first[text], start[at], stop[at + words_n - 1], digest, behind, stop[at + words_n + behind - 1], tail, *bands)


def paragraphs(data: bytes, words_n: int = WORDS, reach: int = REACH) -> tuple[np.ndarray, ...] | None:
    """``text_paragraphs`` of one text, A-Z lower-cased first, without the text's place."""
    found = text_paragraphs([data.lower()], words_n, reach)
    return None if found is None else found[1:]


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text_id, text): null ids as the least long, a hash of the text, the text as bytes; whether ids are unique.

    Where all rows have an id of their own, the id tells texts apart and ``text_id`` is 0, which costs nothing to shuffle.
    """
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col("doc_id").cast("long"))).first()
    doc = "coalesce(cast(doc_id as long), -9223372036854775808L) as doc_id"
    texts = docs.selectExpr(doc, "cast(cast(text as string) as binary) as text")
    return texts.select("doc_id", (F.lit(0).cast("long") if n == ids else F.xxhash64("text")).alias("text_id"), "text"), n == ids


def paragraph_table(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, pos, start, size, digest, behind, more, tail, v0, v1) of all paragraphs.

    ``start`` is an offset in UTF-8 bytes, ``size`` the bytes of the paragraph and ``more`` those of the words behind it.
    """
    names = ["doc_id", "text_id", "pos", "start", "size", "digest", "behind", "more", "tail", "v0", "v1"]
    small = {"pos", "start", "size", "behind", "more"}
    schema = ", ".join(f"{n} {'int' if n in small else 'long'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, texts in text_groups(batch.column(2)):
                found = text_paragraphs(texts)
                if found is not None:
                    text, at, start, stop, digest, behind, end, *hashes = found
                    cols = [docs[first + text], ids[first + text], at, start, stop - start, digest, behind, end - stop, *hashes]
                    arrays = [pa.array(c.astype(np.int32) if n in small else c.view(np.int64)) for n, c in zip(names, cols)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def max_missing(n: int, similarity: float = SIMILARITY) -> int:
    """How many of n shingles may be missing in another set of n: (n - k) / (n + k) stays at ``similarity`` or more."""
    return int(n * (1 - similarity) / (1 + similarity) + 1e-9)


def _subset_keys(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Hashes of the sets left of each row after every deletion of as many shingles as may be missing; repeats are numbered."""
    s = np.sort(shingles, axis=1)
    repeat = np.zeros(s.shape, np.uint64)
    for i in range(1, s.shape[1]):
        repeat[:, i] = np.where(s[:, i] == s[:, i - 1], repeat[:, i - 1] + np.uint64(1), np.uint64(0))
    mixed = _mix(_mix(s) + repeat * np.uint64(0x9E3779B97F4A7C15))
    gone = np.array(list(combinations(range(s.shape[1]), max_missing(s.shape[1], similarity))), np.int64)
    return mixed.sum(axis=1, dtype=np.uint64)[:, None] - mixed[:, gone].sum(axis=2, dtype=np.uint64)


def subset_keys(shingles: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Keys of one paragraph's shingles.

    All paragraphs have equally many shingles, so two of them are similar exactly
    if they have such a set in common.
    """
    return sorted(set(_subset_keys(shingles[None], similarity)[0].tolist()))


def deletion_keys(words: np.ndarray) -> np.ndarray:
    """Hashes of the words left of each row (one paragraph's word hashes) after every deletion of one, in order.

    Two paragraphs have one in common exactly if all but one word of either stand in the other in the same order.
    """
    place = np.arange(words.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    kept, moved = _mix(_mix(words) + place), np.zeros_like(words)
    moved[:, 1:] = _mix(_mix(words[:, 1:]) + place[:-1])
    before = np.cumsum(kept, axis=1, dtype=np.uint64) - kept
    after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    return _mix(before + after)


def near_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of rows of word hashes: two paragraphs are near exactly if they share a key."""
    runs = np.sort(_along(words, 3), axis=1)
    twice = np.flatnonzero((runs[:, 1:] == runs[:, :-1]).any(axis=1))
    deleted, left = deletion_keys(words), _subset_keys(_along(words[twice], SHINGLE))
    row = np.concatenate([np.repeat(np.arange(len(words)), deleted.shape[1]), np.repeat(twice, left.shape[1])])
    return row, np.concatenate([deleted.ravel(), left.ravel()])


def near_edges(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Edges (a, b) between digests of distinct paragraphs that are near."""
    firsts = units.groupBy("digest").agg(F.min(F.struct("doc_id", "text_id", "pos")).alias("first"), F.min("v0").alias("v0"), F.min("v1").alias("v1"))
    bands = firsts.select("first.doc_id", "first.text_id", "first.pos", F.explode(F.array("v0", "v1")).alias("v"))
    buckets = bands.groupBy("v").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("text_id").alias("t0"), F.max("text_id").alias("t1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    busy = buckets.where("d0 <> d1 or t0 <> t1 or p0 <> p1").select(F.col("v").alias("b_v"))
    colliding = bands.join(busy, F.col("v") == F.col("b_v"), "left_semi")
    # A list holds places of one text: rows without an id or with a repeated one do not meet in it.
    wanted = colliding.groupBy(F.col("doc_id").alias("w_doc"), F.col("text_id").alias("w_text")).agg(F.collect_set("pos").alias("wanted"))
    wanted = staged(wanted, "passages-colliding")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for first, texts in text_groups(batch.column(0)):
                h, _, _, begin, counts, _, _ = word_table(texts)
                mine = wanted.slice(first, len(texts))
                at, text = mine.flatten().to_numpy(), np.repeat(np.arange(len(texts)), mine.value_lengths().to_numpy())
                at = (begin[text] + at)[at + WORDS <= counts[text]]
                for lo in range(0, len(at), GROUP_PARAGRAPHS):
                    words = h[at[lo : lo + GROUP_PARAGRAPHS, None] + np.arange(WORDS)]
                    row, key = near_keys(words)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_along(words, WORDS)[:, 0][row].view(np.int64))], ["key", "digest"])

    same = (F.col("doc_id") == F.col("w_doc")) & (F.col("text_id") == F.col("w_text"))
    keyed = rows.join(wanted, same).select("text", "wanted").mapInArrow(keys, "key long, digest long")
    # Both uses share one exchange by key.
    keyed = staged(keyed, "passages-keys").repartition("key")
    least = keyed.groupBy("key").agg(F.min("digest").alias("b"), F.max("digest").alias("most")).where("b <> most").select(F.col("key").alias("l_key"), "b")
    # All paragraphs that have the same left are near each other: a star holds every link.
    return keyed.join(least, F.col("key") == F.col("l_key")).where("digest <> b").select(F.col("digest").alias("a"), "b")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Spans of (doc_id, text) that repeat across documents.

    One row per span: doc_id, text_id (a hash of the text if ids are missing or
    repeated in the table, else null), start, stop (bytes of the UTF-8 text), n_words, class_id (digest of
    its first paragraph's class), first_doc_id and removed: a span is the union of
    overlapping or touching repeated paragraphs with the same ``removed``; it is
    false where the document holds the first paragraphs (by id, text and place) of
    their classes, which stay.  Removed paragraphs reach as far as the words behind
    them are those behind the first one, up to ``BEHIND`` more.  Texts under ``WORDS`` words, null and empty texts
    have no paragraphs; rows that share an id are one document, rows without one
    too, but each of their texts has its own spans (equal ones once).  An empty
    table has no spans.
    """
    rows, unique = _rows(docs)
    units = staged(paragraph_table(rows), "passages")
    distinct = units.groupBy("digest").agg(F.min(F.struct("doc_id", "text_id", "pos", "tail")).alias("first"), F.max("doc_id").alias("last_doc"))
    parts = components(near_edges(rows, units))
    parts = parts.select(F.col("node"), "component")
    groups = distinct.select("digest", "first", "last_doc").join(parts, F.col("digest") == F.col("node"), "left").withColumn("class_id", F.coalesce("component", "digest"))
    # Classes with paragraphs of several documents; only near ones need a second aggregation.
    near = groups.where("component is not null").groupBy("class_id").agg(F.min("first").alias("first"), F.max("last_doc").alias("last_doc"))
    members = groups.where("component is not null").select("digest", F.col("class_id").alias("m_class")).join(near, F.col("m_class") == F.col("class_id")).select("digest", "class_id", "first", "last_doc")
    alone = groups.where("component is null").select("digest", "class_id", "first", "last_doc")
    repeated = members.union(alone).where(F.col("first.doc_id") != F.col("last_doc"))
    repeated = staged(repeated.select(F.col("digest").alias("r_digest"), "class_id", "first"), "passages-repeated")
    hits = units.drop("v0", "v1").join(repeated, F.col("digest") == F.col("r_digest"))
    # What overlaps the first paragraph of its class in the same text is no copy of it.
    here = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    hits = hits.withColumn("removed", ~(here & (F.abs(F.col("pos") - F.col("first.pos")) < WORDS)))
    on = F.col("removed") & (F.col("tail") == F.col("first.tail"))
    hits = hits.withColumn("to", F.col("pos") + WORDS + F.when(on, F.col("behind")).otherwise(0)).withColumn("stop", F.col("start") + F.col("size") + F.when(on, F.col("more")).otherwise(0))
    hits = hits.select("doc_id", "text_id", "pos", "to", "start", "stop", "removed", "class_id", F.col("first.doc_id").alias("first_doc_id"))
    if not unique:  # copies of one text under one id would meet in one group below
        hits = hits.dropDuplicates(["doc_id", "text_id", "pos"])
    # Join overlapping and touching paragraphs of a document into spans.
    line = Window.partitionBy("doc_id", "text_id", "removed").orderBy("pos")
    far = F.max("to").over(line.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.withColumn("new", (far.isNull() | (F.col("pos") > far)).cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "text_id", "removed", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("to") - F.min("pos")).cast("long").alias("n_words"),
        F.min_by("class_id", "pos").alias("class_id"), F.min_by("first_doc_id", "pos").alias("first_doc_id"),
    )
    none = F.lit(-(2**63))
    return out.select(F.nullif("doc_id", none).alias("doc_id"), F.nullif("text_id", F.lit(0)).alias("text_id"), "start", "stop", "n_words", "class_id", F.nullif("first_doc_id", none).alias("first_doc_id"), "removed")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat in other documents: spans with their class and whether they go."""
    prepare(spark)
    return repeated_passages(documents(spark, sf_dir))
