"""Phrase collocations by set-oriented relational mining (SETM).

The relation of occurrences has the words of every document at their positions.
Positions skip a number between pieces and where a word is not frequent, so
neighbours are positions that differ by one.  It is stored in blocks of about
``BLOCK_BYTES`` of text, bucketed and sorted by block: a row has the different
words of its block and the word at every position.  The relation of the phrases of a
length is stored likewise, as the positions at which they begin.  For every length:

1.  merge-join the relation of the phrases one word shorter with that of the words
    (buckets meet bucket by bucket, without a shuffle; the words are their own
    phrases of one word): neighbours make a phrase that is a word longer,
2.  count these phrases by hash, in tables of ``2 ** HASHES`` counts,
3.  group and count those whose hash is frequent exactly, by the ids of their words,
    and keep the frequent ones,
4.  semi-join the occurrences with the frequent hashes and store the positions that
    are left for the next length.

A phrase can only be frequent if the phrases without its first and without its last
word are, and a hash is counted at least as often as each of its phrases, so nothing
is lost; what only shares a frequent hash is counted exactly as well, and dropped.
Word counts, phrase counts and semi-joins run over all occurrences.  A block sends one
number for all its equal phrases, packed with others by their hash, so no task depends
on how frequent a phrase is, and a table of frequent hashes has ``2 ** MOST_BITS`` bits
at most.  A lookup that is too large to broadcast meets its heavy keys by a broadcast
of a proven size and the others by a shuffle (``common.lookup_join``).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.llm.common import ascii_lower, documents, lookup_join, prepare, scratch_path, staged

#: Characters between pieces and between words.
PIECE_END, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Lookup tables up to so many rows and bytes are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 64 << 20
#: Stored tables take little native memory this way; blocks are packed more tightly.
COMPRESSION, BLOCK_COMPRESSION = "snappy", "zstd"
#: Shares of a language in the first of the two steps that rank its phrases.
RANK_SHARES = 64
#: Bytes of text in a block, those that wait for the rest of their blocks, and blocks that are read from a file at once.
BLOCK_BYTES, WAITING_BYTES, BLOCKS_AT_ONCE = 4 << 20, 16 << 20, 4
#: Counts in a table of hashes, occurrences that it takes, and bits of the table of frequent ones (all as powers of two).
HASHES, TABLE_ROWS, MOST_BITS = 22, 21, 27
#: Occurrences whose phrases one task counts exactly, and counts that a task collects before it sends them (powers of two).
COUNT_ROWS, SENT_ROWS = 19, 20
#: Longer words are hashed one by one.
LONG_WORD = 64
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_ENDS = b".,;:!?\n\x0b\x0c\r"
_ANY_END = re.compile(b"[" + _ENDS + b"]")
_WORD, _END = 1, 2
_KIND = bytes(_END if c in _ENDS else 0 if c in b"\t " else _WORD for c in range(256))


def word_rows(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc, lang, pos, word) of every word of every text, the relation that ``word_blocks`` packs; with ``buckets`` the texts are dealt by ``doc`` first."""
    rows = _texts(docs).select(F.monotonically_increasing_id().alias("doc"), "lang", "text")
    if buckets:
        rows = rows.repartition(buckets, "doc")
    marked = F.regexp_replace(ascii_lower(F.col("text")), PIECE_END, " \n ")  # an end of piece takes a position of its own
    words = rows.select("doc", "lang", F.posexplode(F.split(marked, BETWEEN)).alias("pos", "word"))
    return words.where((F.col("word") != "") & (F.col("word") != "\n"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``BLOCK_BYTES`` that end with a piece; a longer piece stays whole."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        stop = max(text.rfind(c, at, at + BLOCK_BYTES) for c in _ENDS) + 1
        if not stop:
            found = _ANY_END.search(text, at + BLOCK_BYTES)
            stop = found.end() if found else len(text)
        yield text[at:stop]
        at = stop
    if at < len(text):
        yield text[at:]


def _packed(x: np.ndarray, kind: type) -> bytes:
    return x.astype(kind).tobytes()


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def block_columns(texts: list[bytes]) -> tuple[int, bytes, bytes, bytes, bytes]:
    """(words, letters, sizes, counts, codes) of some texts of one language.

    ``codes`` has for every position the word there, by its place among the
    different words, or -1 between pieces; ``letters`` has these words one after the
    other, ``sizes`` their bytes and ``counts`` how often each stands in the block.
    """
    joined = b"\n".join(texts).lower()  # A-Z only; the line break ends the last piece of a text
    kind = np.frombuffer((b"\n" + joined + b"\n").translate(_KIND), np.uint8)
    inside = kind == _WORD
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, n = edge[::2], len(edge) // 2
    bounds = np.zeros(n + 1, np.int32)
    np.cumsum(edge[1::2] - start, out=bounds[1:])
    letters = joined.translate(None, _ENDS + b"\t ")
    words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    code, table = words.indices.to_numpy(), words.dictionary
    gap = np.zeros(n + 1, np.int32)  # ends of pieces before a word
    gap[np.searchsorted(start, np.flatnonzero(kind[1:-1] == _END))] = 1
    place = np.arange(n, dtype=np.int32) + np.cumsum(gap[:n], dtype=np.int32)
    codes = np.full(int(place[-1]) + 1 if n else 0, -1, np.int32)
    codes[place] = code
    sizes = pc.binary_length(table).to_numpy()
    letters = table.buffers()[2].slice(0, int(sizes.sum())).to_pybytes() if len(table) else b""
    return n, letters, sizes.tobytes(), _packed(np.bincount(code, minlength=len(table)), np.int64), codes.tobytes()


BLOCK = "block long, lang string, n long, letters binary, sizes binary, counts binary, codes binary"


def word_blocks(docs: DataFrame) -> DataFrame:
    """The words of all texts in blocks (``BLOCK``), each of one language."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((x, pa.binary()) for x in ("letters", "sizes", "counts", "codes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            del sizes[lang]
            number += 1
            row = (number, lang, *block_columns(waiting.pop(lang)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _parts(text.as_py()):
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] += len(part)
                    if sizes[lang] >= BLOCK_BYTES:
                        yield block(lang)
                    elif sizes.total() >= WAITING_BYTES:
                        yield block(sizes.most_common(1)[0][0])
        for lang in list(waiting):
            yield block(lang)

    return _texts(docs).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_ids(letters: bytes, sizes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A hash of every word, eight bytes at a time, from that of its language on; ``frequent_words`` proves that words differ in it."""
    stop = np.cumsum(sizes, dtype=np.int64)
    start = stop - sizes
    eight = np.ndarray((len(letters) + 1,), "<u8", letters + bytes(8), strides=(1,))
    h = langs + sizes.astype(np.uint64) * _STEP
    rows, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(rows):
        left = np.minimum(sizes[rows] - at, 8).astype(np.uint64)
        lane = eight[start[rows] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[rows] = _mix((h[rows] ^ lane) * _STEP)
        at += 8
        rows = rows[sizes[rows] > at]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(letters[start[i] : stop[i]], int(h[i]))
    return _mix(h)


def _lang_hash(lang: str, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed))


class _Block:
    """One row of the relation of frequent words, with the positions at which phrases of ``k`` words begin, if given."""

    def __init__(self, row: dict):
        self.codes, self.ids = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["ids"], np.uint64)
        bits = np.frombuffer(row["begin"], np.uint8) if "begin" in row else None
        self.begin = self.codes >= 0 if bits is None else np.unpackbits(bits, count=len(self.codes), bitorder="little").view(bool)

    def longer(self) -> np.ndarray:
        """Positions at which two neighbours make a phrase that is a word longer."""
        return np.flatnonzero(self.begin[:-1] & self.begin[1:])

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words from every position on."""
        h = self.ids[self.codes[at]]
        for j in range(1, k):
            h = _mix(h * np.uint64(3) + self.ids[self.codes[at + j]])
        return h

    def counted(self, at: np.ndarray, k: int) -> np.ndarray:
        """Rows of the ids of the words of every different phrase of ``k`` words at these positions, and how often it stands there."""
        key, span = self.codes[at].astype(np.int64), max(1, len(self.ids))
        for j in range(1, k):
            if span * len(self.ids) >= 1 << 62:
                coded = pa.array(key).dictionary_encode()
                key, span = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            key, span = key * len(self.ids) + self.codes[at + j], span * len(self.ids)
        if span == len(self.ids) ** k:  # the key itself tells the words
            key.sort()
            first, words = _starts(key), []
            n, key = np.diff(np.append(first, len(key))), key[first]
            for _ in range(k):
                key, code = key // len(self.ids), key % len(self.ids)
                words.insert(0, self.ids[code])
        else:
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            words = [self.ids[self.codes[at[first] + j]] for j in range(k)]
        return np.stack([*words, n.astype(np.uint64)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


# ---------------------------------------------------------------- frequent hashes
class _Hashes:
    """Which hashes were counted ``least`` times: a table of 2 ** ``bits`` bits, looked up by the first bits of a hash."""

    def __init__(self, shared: Broadcast, bits: int):
        self.shared, self.bits = shared, bits

    def drop(self) -> None:
        """Free the table when all that reads it is stored."""
        self.shared.destroy()

    def hold(self, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - self.bits)
        return (self.shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _sent_hashes(parts: list[tuple[np.ndarray, np.ndarray]], slices: int) -> pa.RecordBatch:
    """Sorted hashes and their numbers, packed by slice: those that stand once, then the others and their numbers."""
    h, n = (np.concatenate(x) for x in zip(*parts))
    slot = (h >> np.uint64(64 - slices)).astype(np.int64) if slices else np.zeros(len(h), np.int64)
    value = (h << np.uint64(slices) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    slot, value, n = slot[order], value[order], n[order]
    places = _starts(slot)
    rows = []
    for lo, hi in zip(places.tolist(), [*places[1:].tolist(), len(slot)]):
        once = n[lo:hi] == 1
        rows.append((int(slot[lo]), value[lo:hi][once].tobytes(), value[lo:hi][~once].tobytes(), _packed(n[lo:hi][~once], np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["slice", "once", "more", "n"])


def _frequent_hashes(relation: DataFrame, of: Callable[[dict], tuple[np.ndarray, np.ndarray]], rows: int, least: int) -> _Hashes:
    """Table of the hashes found ``least`` times; ``of`` gives those of a row and their numbers, ``rows`` in all at most."""
    slices = min(max(0, rows - 1 >> TABLE_ROWS).bit_length(), 16)
    fold = max(0, slices + HASHES - MOST_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for row in _rows(batches):
            parts.append(of(row))
            size += len(parts[-1][0])
            if size >= 1 << SENT_ROWS:
                yield _sent_hashes(parts, slices)
                parts, size = [], 0
        if size:
            yield _sent_hashes(parts, slices)

    def add(table: pa.Table) -> pa.Table:
        def values(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        shift = np.uint32(32 - HASHES)
        total = np.bincount(values("once", np.uint32) >> shift, minlength=1 << HASHES)
        more, n = values("more", np.uint32) >> shift, values("n", np.int64)
        np.add.at(total, more, n)
        often = (total >= least).reshape(-1, 1 << fold).any(axis=1)
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary())})

    sent = relation.mapInArrow(send, "slice int, once binary, more binary, n binary")
    bits = np.zeros((1 << slices, 1 << HASHES - fold - 3), np.uint8)
    for row in sent.groupBy("slice").applyInArrow(add, "slice int, bits binary").toLocalIterator():
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return _Hashes(relation.sparkSession.sparkContext.broadcast(bits.reshape(-1)), slices + HASHES - fold)


# ---------------------------------------------------------------- exact counts
def _count_phrases(joined: DataFrame, k: int, frequent: _Hashes, occurrences: int, least: int) -> DataFrame:
    """(w1 ... wk, n) of the phrases that neighbours in ``joined`` make ``least`` times or more; ``occurrences`` in all at most."""
    shares = (occurrences >> COUNT_ROWS) + 1
    names = [f"w{i}" for i in range(1, k + 1)]

    def sent(parts: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(parts, axis=1)
        h = cells[0]
        for word in cells[1:k]:
            h = _mix(h * np.uint64(3) + word)
        share = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(shares)).astype(np.uint32 if shares > 1 << 16 else np.uint16)
        order = np.argsort(share, kind="stable")
        share, cells = share[order], cells[:, order]
        places = _starts(share)
        rows = [(int(share[lo]), cells[:, lo:hi].tobytes()) for lo, hi in zip(places.tolist(), [*places[1:].tolist(), len(share)])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary()))], ["share", "cells"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for row in _rows(batches):
            block = _Block(row)
            at = block.longer()
            parts.append(block.counted(at[frequent.hold(block.hashes(at, k))], k))
            size += parts[-1].shape[1]
            if size >= 1 << SENT_ROWS:
                yield sent(parts)
                parts, size = [], 0
        if size:
            yield sent(parts)

    def add(table: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(x, np.int64).reshape(k + 1, -1) for x in table["cells"].to_pylist()], axis=1)
        rows = pa.table([pa.array(c) for c in cells], names=[*names, "n"])
        total = rows.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"])
        return total.filter(pc.greater_equal(total["n"], least))

    blobs = joined.mapInArrow(send, "share int, cells binary")
    return blobs.groupBy("share").applyInArrow(add, ", ".join(f"{x} long" for x in [*names, "n"]))


def _bounded(df: DataFrame, size: Column) -> bool:
    """Whether a table with rows of that size is small enough to broadcast (counted)."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return got["n"] <= BROADCAST_ROWS and (got["bytes"] or 0) <= BROADCAST_BYTES


class _Relations:
    """Bucketed, sorted tables of occurrences, and the session that joins them.

    The session is a child of the caller's with the same settings but one: tables
    bucketed by document may be joined on document and position as they lie.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.child = spark, spark.newSession()
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                self.child.conf.set(key, value)
        self.child.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def store(self, df: DataFrame, *by: str) -> DataFrame:
        """A table bucketed by the first of these columns and sorted by all of them, (doc, pos) by default."""
        name, by = f"occurrences_{uuid.uuid4().hex}", by or ("doc", "pos")
        self.names.append(name)
        out = df.write.bucketBy(self.buckets, by[0]).sortBy(*by).option("parquet.block.row.count.limit", BLOCKS_AT_ONCE if "block" in by else 1 << 20)
        out.option("compression", BLOCK_COMPRESSION).option("path", scratch_path(self.spark, "setm")).saveAsTable(name)
        return self.child.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _word_hashes(seed: int) -> Callable[[dict], tuple[np.ndarray, np.ndarray]]:
    def of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return word_ids(row["letters"], np.frombuffer(row["sizes"], np.int32), _lang_hash(row["lang"], seed)), np.frombuffer(row["counts"], np.int64)

    return of


def _word_counts(blocks: DataFrame, frequent: _Hashes, seed: int) -> DataFrame:
    """(lang, word, id, n) of the words with a frequent hash, which is their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, counts = _word_hashes(seed)(row)
            bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int32))]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(row["letters"])])
            kept = pa.array(np.flatnonzero(frequent.hold(ids)))
            columns = [pa.array([row["lang"]] * len(kept), pa.string()), words.take(kept), *(pa.array(x).take(kept) for x in (ids.view(np.int64), counts))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "id", "n"])

    rows = blocks.mapInArrow(run, "lang string, word binary, id long, n long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def frequent_words(blocks: DataFrame, least: int) -> tuple[DataFrame, _Hashes, int]:
    """(lang, word, id, n) of the words that stand ``least`` times or more, the table of their ids, and the seed of the hash that gave them."""
    blocks = blocks.select("lang", "letters", "sizes", "counts")
    rows = blocks.agg(F.sum(F.octet_length("sizes") / 4).cast("long")).first()[0] or 0
    seed = 0
    while True:
        frequent = _frequent_hashes(blocks, _word_hashes(seed), rows, least)
        counts = staged(_word_counts(blocks, frequent, seed), "setm-words", COMPRESSION)
        # Words that share an id share its place in the table, so all of them are counted here.
        if counts.groupBy("id").count().where("count > 1").isEmpty():
            return counts.where(F.col("n") >= least), frequent, seed
        frequent.drop()
        seed += 1


def _occurrences(blocks: DataFrame, frequent: _Hashes, seed: int) -> DataFrame:
    """(block, m, ids, codes): the frequent words of every block, and which of them stands at every position, -1 where none does; ``m`` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = word_ids(row["letters"], np.frombuffer(row["sizes"], np.int32), _lang_hash(row["lang"], seed))
            kept = frequent.hold(ids)
            number = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
            codes = np.append(number, np.int32(-1))[np.frombuffer(row["codes"], np.int32)]  # -1 takes the last
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([int((codes >= 0).sum())]), pa.array([ids[kept].tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["block", "m", "ids", "codes"])

    return blocks.select("block", "lang", "letters", "sizes", "codes").mapInArrow(run, "block long, m long, ids binary, codes binary")


def _semi(joined: DataFrame, k: int, frequent: _Hashes) -> DataFrame:
    """(block, m, begin): the ``m`` positions, as bits, at which phrases of ``k`` words with a frequent hash begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            at, begin = block.longer(), np.zeros(len(block.codes), bool)
            begin[at[frequent.hold(block.hashes(at, k))]] = True
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([int(begin.sum())]), pa.array([np.packbits(begin, bitorder="little").tobytes()], pa.binary())], ["block", "m", "begin"])

    return joined.mapInArrow(run, "block long, m long, begin binary")


def _phrase_hashes(k: int) -> Callable[[dict], tuple[np.ndarray, np.ndarray]]:
    def of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        block = _Block(row)
        h = block.hashes(block.longer(), k)
        h.sort()
        first = _starts(h)
        return h[first], np.diff(np.append(first, len(h)))

    return of


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words of every language (lang, n), frequent words (lang, word, id, n), and per length from 2 on the phrases (w1 ... wk, n)."""
    spark = docs.sparkSession
    blocks = staged(word_blocks(docs), "setm-blocks", BLOCK_COMPRESSION, BLOCKS_AT_ONCE)
    words, frequent, seed = frequent_words(blocks, least)
    relations = _Relations(spark)
    try:
        occurrences = relations.store(_occurrences(blocks, frequent, seed).repartition(relations.buckets, "block"), "block")
        frequent.drop()
        joined, rows = occurrences, occurrences.agg(F.sum("m")).first()[0] or 0
        found: list[DataFrame] = []
        for k in range(2, longest + 1):
            frequent = _frequent_hashes(joined.drop("m"), _phrase_hashes(k), rows, least)
            phrases = _count_phrases(joined.drop("m"), k, frequent, rows, least)
            path = scratch_path(spark, f"setm-phrases-{k}")
            phrases.write.option("compression", COMPRESSION).parquet(path)
            found.append(spark.read.schema(phrases.schema).parquet(path))  # in the caller's session
            if k < longest:
                begins = relations.store(_semi(joined.drop("m"), k, frequent), "block")
                joined, rows = occurrences.drop("m").join(begins.hint("merge"), "block"), begins.agg(F.sum("m")).first()[0] or 0
            frequent.drop()
    finally:
        relations.drop()
    return blocks.groupBy("lang").agg(F.sum("n").alias("n")), words, found


def _with(rows: DataFrame, table: DataFrame, on: Sequence[str], like: DataFrame | None = None, size: Column | None = None) -> DataFrame:
    """Inner join on ``on``, unique in ``table``; if the table is not broadcast, keys of many rows are dealt by their number of rows.

    ``like`` has as many rows of every key as ``rows``, if it is there to be read.
    """
    on = list(on)
    if _bounded(table, F.lit(64 * len(on)) if size is None else size):
        return rows.join(F.broadcast(table), on)
    weight = (rows if like is None else like).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return lookup_join(rows, staged(table.join(weight, on), "setm-lookup", COMPRESSION), on, "_rows").drop("_rows")


def _names(first: int, last: int) -> list[str]:
    return [f"w{i}" for i in range(first, last + 1)]


def _outside(found: Sequence[DataFrame], n: int) -> DataFrame:
    """The phrases of ``n`` words but those that mostly occur inside a longer candidate."""
    rows = found[n - 2]
    inner = [t.select(*(F.col(w).alias(v) for w, v in zip(_names(i, i + n - 1), _names(1, n))), F.col("n").alias("longer"))
             for k, t in enumerate(found[n - 1 :], n + 1) for i in range(1, k - n + 2)]
    if not inner:
        return rows
    covers = reduce(DataFrame.unionByName, inner).groupBy(*_names(1, n)).agg(F.max("longer").alias("longer"))
    return rows.join(covers, _names(1, n), "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("n"), F.lit(True))).drop("longer")


def _scored(words: DataFrame, found: Sequence[DataFrame], k: int) -> DataFrame:
    """(lang, ws, a, l, r, score) of the phrases of ``k`` words, with the lowest-scoring of their cuts."""
    rows = base = staged(_outside(found, k), f"setm-outside-{k}", COMPRESSION) if k < len(found) + 1 else found[k - 2]
    rows = rows.withColumnRenamed("n", "a")
    known = [words.select(F.col("id").alias("w1"), "n"), *found]
    cuts = []
    for cut in range(1, k):
        first = words.select(F.col("id").alias("w1"), F.col("n").alias("l1"), "lang") if cut == 1 else known[cut - 1].withColumnRenamed("n", f"l{cut}")
        rows = _with(rows, first, _names(1, cut), base)
        rest = known[k - cut - 1].select(*(F.col(w).alias(v) for w, v in zip(_names(1, k - cut), _names(cut + 1, k))), F.col("n").alias(f"r{cut}"))
        rows = _with(rows, rest, _names(cut + 1, k), base)
        a, left, right = (f"cast({c} as decimal(38,0))" for c in ("a", f"l{cut}", f"r{cut}"))
        score = F.expr(f"(cast(1000000 as decimal(38,0)) * ({a} * {a})) div ({left} * {right})")
        cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return rows.select("lang", F.array(*_names(1, k)).alias("ws"), "a", best.alias("best")).select("lang", "ws", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every language -> (lang, rank, phrase, a, l, r, n, score).

    ``docs`` has (text, lang).  A null text is empty, a null language is ``und``;
    repeated rows count each time, further columns are ignored, an empty table or
    one without frequent phrases has no rows.  Words of any length are kept whole.
    Scores are exact while counts stay below 10 ** 16.
    """
    totals, words, found = frequent_phrases(docs, least, longest)
    scored = reduce(DataFrame.unionByName, (_scored(words, found, k) for k in range(2, longest + 1)))

    # best of every share of a language first, so that no task sorts all phrases of one; equal ones stay until they are spelt
    order = [F.desc("score"), F.desc("a")]
    share = scored.withColumn("share", F.pmod(F.xxhash64("ws"), F.lit(RANK_SHARES)))
    near = share.withColumn("rank", F.rank().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    near = staged(near, "setm-scored", COMPRESSION)

    # words of the ids
    spelt = _with(near.select("ws", F.posexplode("ws").alias("i", "id")), words.select("id", "word"), ["id"], size=F.octet_length("word") + 64)
    spelt = spelt.groupBy("ws").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))  # ``longest`` words at most
    rows = near.join(spelt, "ws").withColumn("phrase", F.concat_ws(" ", "words.word"))
    order = [*order, F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language of ``documents``."""
    prepare(spark)
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, doc, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
occ AS (SELECT lang, doc, i, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT lang, doc, i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
nxt AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM occ WINDOW o AS (PARTITION BY doc, i ORDER BY pos)),
f1 AS (SELECT lang, w, count(*) AS f FROM nxt GROUP BY ALL),
f2 AS (SELECT lang, w, w2, count(*) AS f FROM nxt WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w, w2, w3, count(*) AS f FROM nxt WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cut AS (
  SELECT p.lang, p.w || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w = p.w JOIN f1 y ON y.lang = p.lang AND y.w = p.w2
  WHERE p.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM f3 t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f AND ((t.w = p.w AND t.w2 = p.w2) OR (t.w2 = p.w AND t.w3 = p.w2)))
  UNION ALL
  SELECT p.lang, p.w || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w = p.w JOIN f2 y ON y.lang = p.lang AND y.w = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w = p.w AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w = p.w3),
scored AS (
  SELECT lang, phrase, a, k, l, r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
