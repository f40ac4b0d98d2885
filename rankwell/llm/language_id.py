"""Language identification by cross-parsing entropy with suffix automata.

For each language a suffix automaton is built over labelled text.  A text is
parsed from left to right into the longest phrases that occur in that labelled
text; a phrase costs the bits of a pointer into it, so samples of different
lengths compare fairly.  The language with the fewest normalised phrases (bits
per letter) wins.  Phrases stay inside a word with its borders: every distinct
word is parsed once per worker and language, whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.llm.common import crc_of_id, documents, prepare

_WORDS = re.compile(r"[^\W\d_]+").findall
UND = "und"


class SuffixAutomaton:
    """All substrings of a text; ``step[state]`` maps a character to the next state."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in step[p]:
                step[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = step[p][ch]
                if length[q] != length[p] + 1:
                    clone = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = clone
                    while p >= 0 and step[p].get(ch) == q:
                        step[p][ch] = clone
                        p = link[p]
                    q = clone
                link[cur] = q
            last = cur
        self.step, self.bits = step, math.log2(len(text) + 2)

    def table(self, codes: dict[str, int]) -> np.ndarray:
        """Next states as a dense (states x characters) table, -1 where there is none; code 0 never matches."""
        out = np.full((len(self.step), len(codes) + 1), -1, np.int32)
        for state, to in enumerate(self.step):
            for ch, nxt in to.items():
                out[state, codes[ch]] = nxt
        return out


def count_phrases(table: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Longest-match phrases of each row of a (words x characters) matrix of codes, all rows in lockstep.

    A character that never occurs is a phrase of its own.
    """
    n, width = chars.shape
    count, out = table.shape[1], np.zeros(n, np.int64)
    flat, nxt = chars.ravel(), table.ravel()
    lane, state, at = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    phrases = np.zeros(n, np.int64)
    while len(lane):
        to = nxt[state * count + flat[lane * width + at]].astype(np.int64)
        stop = to < 0
        alone = stop & (state == 0)  # no phrase begins with this character
        phrases += stop
        at += ~stop | alone
        state = np.where(stop, 0, to)
        over = at >= width
        if over.any():
            out[lane[over]] = phrases[over] + (state[over] != 0)
            left = ~over
            lane, state, at, phrases = lane[left], state[left], at[left], phrases[left]
    return out


class CrossParser:
    """Bits of words under each language; a memo of two generations holds the frequent words."""

    def __init__(self, samples: dict[str, str], memo: int = 80_000):
        self.langs = sorted(samples)
        automata = [SuffixAutomaton(samples[x]) for x in self.langs]
        self.codes = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(samples.values()))))}
        self.tables = [a.table(self.codes) for a in automata]
        self.pointer = np.array([a.bits for a in automata])
        self.points = np.zeros(0x110000, np.int16)
        for ch, i in self.codes.items():
            self.points[ord(ch)] = i
        self.memo = memo
        self.new: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}

    def bits(self, words: list[str]) -> np.ndarray:
        """(words x languages): phrases of each word with its borders, times the bits of a pointer."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for i in range(0, len(at), 8192):
                part = at[i : i + 8192]
                chars = np.full((len(part), n + 2), self.codes.get(" ", 0), np.int64)
                points = np.array([words[j] for j in part], dtype=f"<U{n}").view(np.uint32).reshape(len(part), n)
                chars[:, 1:-1] = self.points[points]
                for k, table in enumerate(self.tables):
                    out[part, k] = count_phrases(table, chars) * self.pointer[k]
        return out

    def _learn(self, words: set[str]) -> None:
        new, old, unknown = self.new, self.old, []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    unknown.append(w)
        if unknown:
            new.update(zip(unknown, self.bits(unknown)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the score is the language's share of ``2**-(bits per letter)`` over all."""
        counted = [Counter(_WORDS(t.lower())) if t else Counter() for t in texts]
        if self.langs:
            self._learn(set().union(*counted))
        out = []
        for words in counted:
            times = np.fromiter(words.values(), np.float64, len(words))
            letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words), np.float64, len(words)) @ times
            if not letters or not self.langs:
                out.append((UND, 0.0))
                continue
            per_letter = times @ np.stack([self.new[w] for w in words]) / letters
            share = np.exp2(per_letter.min() - per_letter)
            best = int(per_letter.argmin())
            out.append((self.langs[best], float(share[best] / share.sum())))
        if len(self.new) >= self.memo:
            self.old, self.new = self.new, {}
        return out


def language_samples(labelled: DataFrame, docs_per_lang: int = 400, words_per_doc: int = 2000, chars_per_lang: int = 40_000) -> dict[str, str]:
    """Per language the most frequent distinct words of a bounded sample of (doc_id, text, lang).

    The sample: the ``docs_per_lang`` rows of each language that come first by a
    hash of their id, of each at most ``words_per_doc`` distinct words.  What is
    fitted is bounded by these parameters; everything is counted by Spark and
    ``chars_per_lang`` characters per language reach the driver.
    """
    labelled = labelled.where("lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_lang)
    ids = ids.select(F.col("doc_id").alias("s_id")).distinct()
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))), 1, words_per_doc)
    sample = labelled.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"), "left_semi")
    counts = sample.select("lang", F.explode(words).alias("word")).where(F.length("word") <= 48).groupBy("lang", "word").count()
    best = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = counts.withColumn("chars", F.sum(F.length("word") + 1).over(best)).where(F.col("chars") <= chars_per_lang)
    out: dict[str, list[str]] = {}
    for r in chosen.select("lang", "word", "chars").orderBy("lang", "chars").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: " " + " ".join(ws) + " " for lang, ws in out.items()}


_PARSERS: dict[int, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def identify(docs: DataFrame, samples: dict[str, str], chars_at_once: int = 1 << 21) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  Ties go to the first language in code-point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            found: list[tuple[str, float]] = []
            texts, chars = [], 0
            for text in batch.column(1):
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars >= chars_at_once:
                    found += parser.predict(texts)
                    texts, chars = [], 0
            found += parser.predict(texts) if texts else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from rows whose crc32(doc_id) mod 3 is not 1."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    samples = language_samples(docs.where(~held))
    return identify(docs, samples).select("doc_id", held.alias("held_out"), "lang_pred", "score")
