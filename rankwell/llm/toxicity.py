"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of three and four characters with gaps: a
subsequence weighs ``decay`` for every skipped character and spans at most five
or six places, borders of the word included, so that inserted characters
("idxiot", "i-diot") and new endings change a word's features only in part.

Labelled sentences are bags of words of which a toxic one has at least one
witness.  Witnesses, landmarks and the machine are found on a bounded sample
(``docs_per_class``).  As the kernel's features can be written out, the machine
over the landmarks folds into one weight per feature: scoring a word needs no
loop over landmarks.  A text scores as its most toxic word, and every distinct
word is scored once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import crc_of_id, documents, prepare, staged
from rankwell.session import read_table

_CORE = re.compile(r"[^\W\d_](?:\S*[^\W\d_])?").findall
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)").finditer
#: One in so many of the sampled rows sets the border and is not fitted.
CALIBRATION = 4
#: Share of the toxic bags that a word needs to be a witness by itself.
STRONG = 0.01
#: Characters of a word that are looked at together; longer words are scored window by window.
WINDOW = 14
_BORDER, _BITS = 31, 5
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DIM = (1 << 3 * _BITS) + (1 << 4 * _BITS)


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words without outer punctuation; spaced-out letters count as one word too."""
    if not text:
        return set()
    text = text.lower()
    found = set(_CORE(text))
    for m in _SPACED(text):
        found.add("".join(m[0].split()))
    return found


def windows(word: str) -> list[str]:
    """The word itself if short, else overlapping windows; if it holds other characters, its runs of letters and all its letters too."""
    units = [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]
    if not word.isalpha():
        # Not by \w, which also has "²" and "½": a part must be all letters, or it would be cut again without end.
        parts = "".join(c if c.isalpha() else " " for c in word).split()
        units += [w for p in {*parts, "".join(parts)} if len(p) >= 3 for w in windows(p)]
    return units


def altered(word: str) -> list[str]:
    """The word with a letter put in at each inner place, and with each inner letter doubled."""
    strange = [chr(97 + (7 * i + len(word)) % 26) for i in range(len(word))]
    return list(dict.fromkeys([word[:i] + c + word[i:] for i in range(1, len(word)) for c in (strange[i], word[i])]))


def _classes(units: list[str], n: int) -> np.ndarray:
    """Character classes of units of n characters, with a border at each end; 0 for what only fills a gap."""
    codes = np.array(units, dtype=f"<U{n}").view(np.uint32).reshape(len(units), n)
    out = np.zeros((len(units), n + 2), np.int32)
    out[:, 0] = out[:, -1] = _BORDER
    inner = out[:, 1:-1]
    ascii_ = (codes >= 97) & (codes <= 122)
    inner[ascii_] = codes[ascii_] - 96
    for a, b in _LEET.items():
        inner[codes == ord(a)] = ord(b) - 96
    other = codes > 127
    inner[other] = 27 + codes[other] % 4
    return out


def features(units: list[str], n: int, decay: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) matrices of the gapped subsequences of units of n characters; rows have unit length.

    A subsequence that occurs twice keeps two entries; the length counts their sum.
    """
    c = _classes(units, n)
    keys = []
    for size, span in ((3, 5), (4, 6)):
        base = 0 if size == 3 else 1 << 3 * _BITS
        for rest in combinations(range(1, span), size - 1):
            width = c.shape[1] - rest[-1]
            if width <= 0:
                continue
            picked = [c[:, o : o + width] for o in (0, *rest)]
            idx, ok = picked[0], picked[0] > 0
            for p in picked[1:]:
                idx, ok = (idx << _BITS) | p, ok & (p > 0)
            keys.append(np.where(ok, ((base + idx) << 2) | (rest[-1] - size + 1), -1))
    if not keys:
        return np.zeros((len(units), 0), np.int32), np.zeros((len(units), 0), np.float32)
    key = np.sort(np.concatenate(keys, axis=1), axis=1)
    weight = np.where(key >= 0, np.float32(decay) ** (key & 3), 0).astype(np.float32)
    idx = np.where(key >= 0, key >> 2, 0)
    square = (weight * weight).sum(axis=1)
    for d in range(1, key.shape[1]):
        same = (idx[:, d:] == idx[:, :-d]) & (weight[:, d:] > 0) & (weight[:, :-d] > 0)
        if not same.any():
            break
        square += 2 * (same * weight[:, d:] * weight[:, :-d]).sum(axis=1)
    return idx, weight / np.sqrt(np.maximum(square, 1e-12))[:, None]


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Positions of units of each length, in parts of bounded size."""
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 8192):
            yield at[i : i + 8192], int(n)


class Features:
    """Features of many units in sparse blocks; products with a dense feature vector."""

    def __init__(self, units: list[str]):
        self.n = len(units)
        self.blocks = [(at, *features([units[i] for i in at], n)) for at, n in by_length(units)]

    def dot(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.float32)
        for at, idx, weight in self.blocks:
            out[at] = (dense[idx] * weight).sum(axis=1)
        return out

    def add_to(self, dense: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        """Adds the sum of the units' features, times their coefficients, to a dense vector."""
        for at, idx, weight in self.blocks:
            np.add.at(dense, idx, weight * coefficients[at, None].astype(np.float32))
        return dense


def kernel(units: list[str], marks: list[str]) -> np.ndarray:
    """(units x marks) matrix of the normalised kernel; one dense vector at a time is held."""
    rows, out = Features(units), np.zeros((len(units), len(marks)), np.float32)
    for j, mark in enumerate(marks):
        out[:, j] = rows.dot(Features([mark]).add_to(np.zeros(DIM, np.float32), np.ones(1)))
    return out


@dataclass
class Model:
    """``weights`` per feature; a word's margin is its product with them less ``bias``, ``slope`` makes it a score."""

    weights: np.ndarray
    bias: float
    slope: float

    def margins(self, words: list[str]) -> np.ndarray:
        units, owner = [], []
        for i, w in enumerate(words):
            for u in windows(w):
                units.append(u)
                owner.append(i)
        out = np.full(len(words), -self.bias, np.float64)
        if units:
            np.maximum.at(out, np.array(owner), Features(units).dot(self.weights).astype(np.float64) - self.bias)
        return out

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -50, 50))))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps over the rows inside the margin; the last column is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[-1, -1] = 1e-8
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(eye + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _spread_out(units: list[str], limit: int) -> list[str]:
    """Up to ``limit`` units, each the one least like those before it."""
    if len(units) <= limit:
        return units
    rows, like, chosen = Features(units), np.full(len(units), -np.inf), [0]
    while len(chosen) < limit:
        like = np.maximum(like, rows.dot(Features([units[chosen[-1]]]).add_to(np.zeros(DIM, np.float32), np.ones(1))))
        chosen.append(int(like.argmin()))
    return [units[i] for i in dict.fromkeys(chosen)]


def fit_words(positive: dict[str, int], negative: list[str], hard: list[str], landmarks: int = 192, max_altered: int = 64) -> Model:
    """Machine over Nystroem features of the landmarks; ``positive`` has the bags that each witness explains.

    The ``max_altered`` witnesses that explain most are also learned with letters
    put in or doubled, at a tenth of the weight each.
    """
    pos = sorted(positive, key=lambda w: (-positive[w], w))
    changed = [a for w in pos[:max_altered] if w.isalpha() and len(w) < WINDOW for a in altered(w)]
    marks = list(dict.fromkeys([*[windows(w)[0] for w in pos[: landmarks // 2]], *_spread_out([u for w in hard for u in windows(w)], landmarks // 4), *[windows(w)[0] for w in negative[: landmarks // 4]]]))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm to the power -1/2
    words = [*pos, *changed, *negative, *hard]
    x = kernel([windows(w)[0] for w in words], marks).astype(np.float64) @ root
    y = np.concatenate([np.ones(len(pos) + len(changed)), -np.ones(len(negative) + len(hard))])
    weight = np.concatenate([np.ones(len(pos)), np.full(len(changed), 0.1), np.ones(len(negative) + len(hard))])
    for sign in (1, -1):
        weight[y == sign] *= len(words) / 2 / weight[y == sign].sum()
    w = fit_svm(x, y, weight)
    return Model(Features(marks).add_to(np.zeros(DIM, np.float32), root @ w[:-1]), float(-w[-1]), 4.0)


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 3000, max_candidates: int = 4000, max_negative: int = 8000, max_hard: int = 4000) -> Model | None:
    """Machine from (doc_id, text) and (doc_id, toxic); None if either label is missing.

    Fitted on at most ``docs_per_class`` rows of each label, the first by a hash
    of their id; every ``CALIBRATION``-th of them sets the border instead.  The
    sample is chosen by ids alone and sent to the texts.  Words are counted by
    Spark; at most ``max_candidates`` witness candidates, ``max_negative`` words of
    clean sentences and ``max_hard`` of those that look most toxic reach the driver.
    """
    toxic = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("s_toxic"))
    known = docs.where("text is not null").select("doc_id").distinct().join(toxic, F.col("doc_id") == F.col("l_id"))
    known = staged(known.select(F.col("l_id").alias("s_id"), F.col("s_toxic").cast("int").alias("toxic")), "toxicity-known")
    first = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("s_id"), "s_id").limit(docs_per_class) for label in (0, 1)]
    ids = first[0].unionByName(first[1])
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = sorted(w for w in words_of(text.as_py()) if len(w) <= 2 * WINDOW)
                # A MinHash of the bag: near copies of a document mostly have the same one.
                sketch = min((xxhash.xxh64_intdigest(w) >> 1 for w in found), default=0)
                same = [pa.array([x] * len(found), t) for x, t in ((doc, pa.int64()), (toxic, pa.int32()), (sketch, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found, pa.string())], ["doc_id", "toxic", "sketch", "word"])

    bags = staged(sample.selectExpr("cast(doc_id as long) doc_id", "text", "toxic").mapInArrow(words, "doc_id long, toxic int, sketch long, word string"), "toxicity-words")
    fitted = bags.where(F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) != 0)
    counts = staged(fitted.groupBy("word").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "toxicity-counts")
    bags_n = fitted.where("toxic = 1").agg(F.countDistinct("sketch")).first()[0]
    # Witness candidates: in several toxic bags (near copies count once), hardly in clean ones.
    candidates = counts.where("pos >= 3 and pos > 20 * neg").orderBy(F.col("pos").desc(), "word").limit(max_candidates)
    pairs = fitted.where("toxic = 1").join(F.broadcast(candidates.select(F.col("word").alias("c_word"), "pos", "neg")), F.col("word") == F.col("c_word")).select("doc_id", "word", "pos", "neg").collect()
    clean = counts.where("neg >= 1")
    negative = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(max_negative).collect()]
    if not pairs or not negative:
        return None
    of_bag: dict[int, list[tuple[str, int]]] = {}
    for r in pairs:
        of_bag.setdefault(r["doc_id"], []).append((r["word"], r["pos"]))

    # A word of many toxic bags and no clean one is a witness beside others too.
    strong = {r["word"]: r["pos"] for r in pairs if r["neg"] == 0 and r["pos"] >= max(5, STRONG * bags_n)}

    def witnesses(value) -> dict[str, int]:
        """One witness per toxic bag, and how many bags each explains (a word that explains one bag only is noise); the strong words."""
        chosen: dict[str, int] = {}
        for found in of_bag.values():
            w = max(found, key=value)[0]
            chosen[w] = chosen.get(w, 0) + 1
        several = {w: n for w, n in chosen.items() if n >= 2}
        return (several or chosen) | strong

    positive = witnesses(lambda x: (x[1], x[0]))
    model = fit_words(positive, negative, [])
    for _ in range(2):
        # Words of clean sentences that look most toxic join the training set.
        hard = [r["word"] for r in margins(clean.select("word"), model).orderBy(F.col("margin").desc(), "word").limit(max_hard).collect()]
        vocabulary = sorted({w for found in of_bag.values() for w, _ in found})
        margin = dict(zip(vocabulary, model.margins(vocabulary)))
        positive = witnesses(lambda x: (round(float(margin[x[0]]), 3), x[1], x[0]))
        sure = {w for w in vocabulary if margin[w] > 0.5}
        positive = {w: positive.get(w, 1) for w in {*positive, *sure}}
        model = fit_words(positive, negative, hard[: max_hard // 2])
    # The border is set on bags that were not fitted: where it makes the fewest errors.
    held = bags.where(F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0)
    scored = margins(held.select("word").distinct(), model).withColumnRenamed("word", "m_word")
    best = held.join(scored, F.col("word") == F.col("m_word")).groupBy("doc_id", "toxic").agg(F.max("margin").alias("margin")).collect()
    border = best_border(np.array([r["margin"] for r in best]), np.array([r["toxic"] for r in best]))
    return Model(model.weights, model.bias + border, model.slope)


def best_border(margin: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the widest gap among the borders with the fewest errors; 0 if there are not both labels."""
    if not len(margin) or toxic.all() or not toxic.any():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], toxic[order]
    # Errors with the border between rows i - 1 and i: toxic ones below, clean ones from there on.
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    gaps = np.concatenate([[0.0], np.diff(m), [0.0]])
    at = max(np.flatnonzero(errors == errors.min()), key=lambda i: gaps[i])
    return float(m[0] if at == 0 else m[-1] + 1e-9 if at == len(m) else (m[at - 1] + m[at]) / 2)


def margins(words: DataFrame, model: Model) -> DataFrame:
    """(word, margin) of a table of words."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.margins(batch.column(0).to_pylist()))], ["word", "margin"])

    return words.mapInArrow(run, "word string, margin double")


class _Scorer:
    """Margins of words with a memo of two generations."""

    def __init__(self, model: Model, memo: int = 80_000):
        self.model, self.memo = model, memo
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def best(self, bags: list[set[str]]) -> list[float]:
        """The highest margin of each bag of words."""
        new, old = self.new, self.old
        unknown = []
        for w in set().union(*bags):
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    unknown.append(w)
        if unknown:
            new.update(zip(unknown, self.model.margins(unknown).tolist()))
        none = -self.model.bias
        out = [max(map(new.__getitem__, bag), default=none) for bag in bags]
        if len(new) >= self.memo:
            self.old, self.new = new, {}
        return out


_SCORERS: dict[str, _Scorer] = {}


def _scorer(model: Model) -> _Scorer:
    key = hashlib.sha256(model.weights.tobytes() + repr((model.bias, model.slope)).encode()).hexdigest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = _Scorer(model)
    return _SCORERS[key]


def _scored(batches: Iterator[pa.RecordBatch], column: int, scorer: _Scorer, chars_at_once: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the scores of their texts; words are looked up for about ``chars_at_once`` characters at a time."""
    for batch in batches:
        scores: list[float] = []
        bags, chars = [], 0
        for text in batch.column(column):
            text = text.as_py()
            bags.append(words_of(text))
            chars += len(text or "")
            if chars >= chars_at_once:
                scores += map(scorer.model.score, scorer.best(bags))
                bags, chars = [], 0
        if bags:
            scores += map(scorer.model.score, scorer.best(bags))
        yield batch, np.array(scores, dtype=np.float64)


def score(docs: DataFrame, model: Model | None, chars_at_once: int = 1 << 20) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) for every row of (doc_id, text).

    A null or empty text, or one without letters, has no features and scores by
    the border alone (under 0.5).  Without a model every score is 0.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, 1, _scorer(shared.value), chars_at_once):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, chars_at_once: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns; the text is the column ``text``."""
    if model is None:
        return docs
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, column, _scorer(shared.value), chars_at_once):
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows to learn from: crc32(doc_id) mod 5 is not 0."""
    return docs.select("doc_id", "text").where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0)


def trained(spark: SparkSession, sf_dir: str) -> Model | None:
    """Machine from the labelled part of ``documents``."""
    return train(learnable(documents(spark, sf_dir)), read_table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from rows whose crc32(doc_id) mod 5 is not 0."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    held = (F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0).alias("held_out")
    return score(docs, trained(spark, sf_dir)).select("doc_id", held, "score", "predicted")
