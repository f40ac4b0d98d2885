"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1.  The words of the whole corpus are counted; the frequent ones, at most
    ``LEXICON_WORDS``, are merged once.
2.  They are compiled into a minimal acyclic automaton over their bytes: words
    that end alike share the states of their ends.  Every arc carries a number;
    the sum over a word's path is its place in the order of all words, and there
    lie its ids.  So numbers come out along the arcs, and suffixes stay shared
    although the ids of words differ.
3.  The file of the transducer goes out with ``SparkContext.addFile``; Python
    workers map it into memory, so that those of one executor share its pages.
4.  Texts are split, the words of a batch walk through the transducer together,
    and words that it does not hold are merged exactly, by rank and position.

What the transducer holds only decides how fast a word is found, never its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import documents, prepare, scratch_path, staged

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Most words of the lexicon, the bytes of its longest word, and the fewest occurrences of one.
LEXICON_WORDS, LEXICON_BYTES, LEXICON_COUNT = 131_072, 64, 8
#: Words that a worker remembers, characters split at once, and words looked up together.
MEMO, SLICE, TOGETHER = 300_000, 1 << 20, 200_000
_ID_BITS = 24
_ID_MASK, _NEVER = (1 << _ID_BITS) - 1, 1 << 62

# Letters and digits that Unicode 16.0 added to 15.1 (first and last code point of each range).
_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Code points with the property White_Space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _char_class(kind: str, added: Iterable[tuple[int, int]]) -> str:
    """Ranges of a character class: code points of category ``kind`` and the added ones."""
    ranges: list[list[int]] = []
    extra = {c for a, b in added for c in range(a, b + 1)}
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind or c in extra:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_RULES: dict[str, re.Pattern] = {}


def split_rules() -> dict[str, re.Pattern]:
    """The split rule of byte-level BPE for any text and for ASCII texts, and the places where long texts may be cut.

    Letters and digits are those of Unicode 16.0, as in the library; a cut before
    a space and a letter, behind a letter, lies between two matches whatever follows.
    """
    if not _RULES:
        for name, letter, digit, space in (("any", _char_class("L", _LETTERS_16), _char_class("N", _DIGITS_16), _SPACE), ("ascii", "A-Za-z", "0-9", "\t-\r ")):
            _RULES[name] = re.compile(
                rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
            _RULES[f"cut-{name}"] = re.compile(rf"(?<=[{letter}])(?= [{letter}])")
    return _RULES


def words_of(text: str) -> Iterator[list[str]]:
    """Matches of the split rule, in slices of long texts."""
    rules = split_rules()
    kind = "ascii" if text.isascii() else "any"
    find, cut = rules[kind].findall, rules[f"cut-{kind}"]
    at = 0
    while len(text) - at > 2 * SLICE:
        border = cut.search(text, at + SLICE)
        if border is None:
            break
        yield find(text[at:border.start()])
        at = border.start()
    yield find(text[at:] if at else text)


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, by its rule: printable bytes stand for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary, merges and special tokens of a tokenizer file; exact merging of words."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters, model = byte_letters(), spec["model"]
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.first = [model["vocab"][c] for c in sorted(letters, key=letters.get)]
        # by left id and right id: the merge's rank and, in the low bits, the id it makes
        self.after: list[dict[int, int]] = [{} for _ in range(max(self.tokens) + 1)]
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.after[model["vocab"][a]][model["vocab"][b]] = n << _ID_BITS | model["vocab"][a + b]

        pairs = sorted((a << _ID_BITS | b, m) for a, row in enumerate(self.after) for b, m in row.items())
        self._first = np.array(self.first, np.int64)
        self._pairs, self._results = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, the leftmost of equals, is merged until none is left."""
        ids = [self.first[b] for b in word]
        if len(ids) > LEXICON_BYTES:
            return self._merge_long(ids)
        after = self.after
        made = [after[a].get(b, _NEVER) for a, b in zip(ids, ids[1:])]
        while made and (best := min(made)) != _NEVER:
            i = made.index(best)
            ids[i] = new = best & _ID_MASK
            del ids[i + 1], made[i]
            if i:
                made[i - 1] = after[ids[i - 1]].get(new, _NEVER)
            if i < len(made):
                made[i] = after[new].get(ids[i + 1], _NEVER)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many short words at once, as packed ids: every round merges the best pair of each word."""
        size = np.array([len(w) for w in words], np.int64)
        ids = self._first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        made = self._made(ids[:-1], ids[1:], word[:-1] == word[1:])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(made, start)
            length = np.diff(np.append(start, len(ids)))
            ended = np.repeat(best == _NEVER, length)
            if ended.any():
                done.append((word[ended], ids[ended]))
                ids, word, made, length, best = ids[~ended], word[~ended], made[~ended], length[best != _NEVER], best[best != _NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(made == np.repeat(best, length))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            ids[at] = best & _ID_MASK
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, word, made = ids[stay], word[stay], made[stay]
            at -= np.arange(len(at))  # one symbol less for every merge to the left
            touched = np.concatenate([at, at[at > 0] - 1])
            right = np.minimum(touched + 1, len(ids) - 1)
            made[touched] = self._made(ids[touched], ids[right], (right > touched) & (word[touched] == word[right]), False)
        if not done:
            return [b""] * len(words)
        word, ids = (np.concatenate(x) for x in zip(*done))
        packed = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _made(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray, last: bool = True) -> np.ndarray:
        """Merges of neighbours (rank and id), ``_NEVER`` where there is none; ``last`` adds an entry for the last symbol."""
        out = np.full(len(left) + last, _NEVER, np.int64)
        at = np.flatnonzero(joined)
        key = left[at] << _ID_BITS | right[at]
        found = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        hit = self._pairs[found] == key if len(self._pairs) else np.zeros(len(at), bool)
        out[at[hit]] = self._results[found[hit]]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked symbols, for words of any length."""
        n, after = len(ids), self.after
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := after[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = ahead[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            new = m & _ID_MASK
            ids[i], ids[j] = new, -1
            ahead[i] = k = ahead[j]
            if k < n:
                back[k] = i
                if (m := after[new].get(ids[k])) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (h := back[i]) >= 0 and (m := after[ids[h]].get(new)) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [t for t in ids if t >= 0]

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text, and special tokens with their id (the leftmost, the longest of those at one place)."""
        if not any(s in text for s in self.special):
            yield text, None
            return
        pattern = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        for i, part in enumerate(re.split(f"({pattern})", text)):
            if part:
                yield part, self.special[part] if i % 2 else None

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


# ---------------------------------------------------------------- the transducer
def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of (word, ids) entries as arrays.

    Words come in byte order, so a state is complete when a word leaves it; it is
    then replaced by an equal one, if there is one (same end mark, same arcs).
    ``arcs`` holds state * 256 + byte in ascending order, ``target`` and ``output``
    the state behind each arc and the number of words before it, ``final`` the end
    marks; word i has ``ids[starts[i] : starts[i + 1]]``.  State 0 is the start.
    """
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    below: list[int] = []  # words from a state on

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            below.append(int(node[0]) + sum(below[s] for _, s in key[1]))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""

    def leave(depth: int) -> None:
        while len(path) > depth + 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    for word, _ in entries:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        leave(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    leave(0)
    root = settle(path[0])
    order = {root: 0}  # the start gets number 0, the others follow
    for s in range(len(states)):
        order.setdefault(s, len(order))
    arcs, target, output, final = [], [], [], np.zeros(len(states), np.uint8)
    for s, number in sorted(order.items(), key=lambda x: x[1]):
        end, out = states[s]
        final[number] = end
        before = int(end)
        for byte, t in out:
            arcs.append(number << 8 | byte)
            target.append(order[t])
            output.append(before)
            before += below[t]
    ids = [t for _, x in entries for t in x]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in entries])])
    return {"arcs": np.array(arcs, np.int64), "target": np.array(target, np.int32), "output": np.array(output, np.int32), "final": final,
            "starts": starts.astype(np.int64), "ids": np.array(ids, np.uint32)}


_FIELDS = (("arcs", np.int64), ("target", np.int32), ("output", np.int32), ("final", np.uint8), ("starts", np.int64), ("ids", np.uint32))


def to_bytes(lexicon: dict[str, np.ndarray]) -> bytes:
    """The arrays one behind the other, each from a multiple of 8 bytes on, after their lengths."""
    out = [np.array([len(lexicon[name]) for name, _ in _FIELDS], "<i8").tobytes()]
    for name, kind in _FIELDS:
        data = lexicon[name].astype(np.dtype(kind).newbyteorder("<")).tobytes()
        out.append(data + b"\0" * (-len(data) % 8))
    return b"".join(out)


class Lexicon:
    """A compiled transducer, read in place from a memory-mapped file (or from bytes)."""

    def __init__(self, source: "str | bytes"):
        raw = np.frombuffer(source, np.uint8) if isinstance(source, bytes) else np.memmap(source, np.uint8, "r")
        lengths = raw[: 8 * len(_FIELDS)].view("<i8")
        at = 8 * len(_FIELDS)
        for (name, kind), n in zip(_FIELDS, lengths.tolist()):
            kind = np.dtype(kind).newbyteorder("<")
            setattr(self, name, raw[at : at + n * kind.itemsize].view(kind))
            at += -(-n * kind.itemsize // 8) * 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of every word, -1 for words that are not in the lexicon: all take one step together per byte."""
        out = np.full(len(words), -1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        at = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        if not len(at) or not len(self.arcs):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            key = state << 8 | flat[first[at] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            live = self.arcs[arc] == key
            at, arc = at[live], arc[live]
            state, total = self.target[arc].astype(np.int64), total[live] + self.output[arc]
            step += 1
            ended = size[at] == step
            hit = ended & (self.final[state] == 1)
            out[at[hit]] = total[hit]
            at, state, total = at[~ended], state[~ended], total[~ended]
        return out

    def ids_of(self, number: int) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class LexiconBPE:
    """Encoder of texts: transducer first, exact merges for the rest; bounded memos of two generations."""

    def __init__(self, merges: Merges, lexicon: Lexicon, memo: int = MEMO):
        self.merges, self.lexicon, self.memo = merges, lexicon, memo
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of words that no memo holds."""
        coded = [w.encode() for w in words]
        unseen: list[int] = []
        for i, n in enumerate(self.lexicon.numbers(coded).tolist()):
            if n >= 0:
                self._new[words[i]] = self.lexicon.ids_of(n)
            elif len(coded[i]) > LEXICON_BYTES:
                self._new[words[i]] = _packed(self.merges.merge(coded[i]))
            else:
                unseen.append(i)
        if unseen:
            self._new.update(zip((words[i] for i in unseen), self.merges.merge_many([coded[i] for i in unseen])))

    def _learn_all(self, held: list[tuple[int, "list[str] | bytes"]]) -> None:
        """Bring the words of several texts into the newer memo."""
        if len(self._new) > self.memo:
            self._old, self._new = self._new, {}
        fresh = set().union(*(words for _, words in held if isinstance(words, list))).difference(self._new)
        seen = fresh & self._old.keys()
        self._new.update((w, self._old[w]) for w in seen)
        self._learn(list(fresh - seen))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids as little-endian unsigned 32-bit integers), in order; a long text comes in slices.

        Words are looked up together for about ``TOGETHER`` words of neighbouring texts.
        """
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def flush() -> Iterator[tuple[int, bytes]]:
            self._learn_all(held)
            for i, words in held:
                yield i, b"".join(map(self._new.__getitem__, words)) if isinstance(words, list) else words
            held.clear()

        for i, text in enumerate(texts):
            for part, special in self.merges.parts(text):
                if special is not None:
                    held.append((i, _packed([special])))
                    continue
                for words in words_of(part):
                    held.append((i, words))
                    size += len(words)
                    if size >= TOGETHER:
                        yield from flush()
                        size = 0
        yield from flush()


# ---------------------------------------------------------------- Spark
def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(column))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of letters that stand behind a space (which is part of the word), over all texts.

    The texts are cut at single spaces and words lose punctuation at their end, so
    this is no full split; it only has to find the frequent words.  Tasks add up
    their own counts before the shuffle, so a very frequent word is no hot key.
    """
    between = docs.select(F.explode(F.split(F.col("text").cast("string"), " ")).alias("word"))
    words = between.select(F.rtrim("word", F.lit(".,;:!?\n")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plain = (F.octet_length("word") < LEXICON_BYTES) & F.col("word").rlike(r"^\p{L}+$")
    return words.where(plain).select(F.concat(F.lit(" "), "word").alias("word"), "n")


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words, at most ``words`` of them: those from a count on, which is read off a histogram.

    The histogram has a bin per quarter of a power of two, so it is a few hundred
    rows whatever the corpus.
    """
    counted = staged(count_words(docs).where(F.col("n") >= LEXICON_COUNT).withColumn("bin", F.floor(F.log2("n") * 4)), "lexicon-words")
    total, least = 0, None
    for row in counted.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        total += row["count"]
        if total > words:
            break
        least = row["bin"]
    return counted.where(F.col("bin") >= least if least is not None else F.lit(False)).select("word", "n")


_KEPT: dict[str, object] = {}


def _merges(data: bytes) -> Merges:
    key = hashlib.sha256(data).hexdigest()
    if _KEPT.get("merges") != key:
        _KEPT.update({"merges": key, "object": Merges(data)})
    return _KEPT["object"]


def _coder(data: bytes, name: str) -> LexiconBPE:
    if _KEPT.get("lexicon") != name:
        _KEPT.update({"lexicon": name, "coder": LexiconBPE(_merges(data), Lexicon(SparkFiles.get(name)))})
    return _KEPT["coder"]


def build_lexicon(docs: DataFrame, shared, words: int = LEXICON_WORDS) -> bytes:
    """The compiled transducer of the frequent words of ``docs``.

    Tasks merge the words; the driver gets ``words`` rows at most, of
    ``LEXICON_BYTES`` bytes each at most, and compiles them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared.value)
        for batch in batches:
            ids = [merges.merge(w.encode()) for w in _texts(batch, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    rows = frequent_words(docs, words).select("word").mapInArrow(run, "word string, ids array<int>").collect()
    return to_bytes(compile_lexicon((r["word"].encode(), list(r["ids"])) for r in rows))


def ship_file(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` into the shared folder and hand it to every executor; returns its name there.

    An executor that joins later, or replaces a lost one, fetches it with its first task.
    """
    jvm, name = spark.sparkContext._jvm, f"lexicon-{uuid.uuid4().hex}.bin"
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    return name


def encode_documents(docs: DataFrame, tokenizer_file: str, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of (doc_id, text); ``with_ids`` adds the ids.

    A null text counts as empty: no ids, and the digests of no bytes.  Strings of
    special tokens in a text become their ids, as the library does by default.
    Rows are independent: repeated rows, null ids and further columns change
    nothing, an empty table has an empty lexicon and no rows, and a text of any
    length is split and encoded in slices of about ``SLICE`` characters.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    name = ship_file(spark, build_lexicon(docs, shared, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, name)
        token = coder.merges.tokens.__getitem__
        for batch in batches:
            n = [0] * batch.num_rows
            ids_sha, text_sha, kept = ([make() for _ in n] for make in (hashlib.sha256, hashlib.sha256, list))
            for i, ids in coder.encode_all(_texts(batch, 1)):
                ids_sha[i].update(ids)
                listed = np.frombuffer(ids, "<u4").tolist()
                # slices end between characters, so each decodes by itself
                text_sha[i].update(b"".join(map(token, listed)).decode("utf-8", "replace").encode())
                n[i] += len(listed)
                if with_ids:
                    kept[i] += listed
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array([h.hexdigest() for h in x], pa.string()) for x in (ids_sha, text_sha))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public byte-level vocabulary."""
    import public_tokenizers

    prepare(spark)
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
