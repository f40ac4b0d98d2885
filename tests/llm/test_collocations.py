"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rankwell.llm import collocations as X
from rankwell.llm import common
from tests.llm.helpers import docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=10, longest=3, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cand = {(g, p): a for (g, p), a in f.items() if len(p) >= 2 and a >= least}
    out = []
    for (g, p), a in cand.items():
        cuts = [(1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        inside = any(g == h and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for (h, q), b in cand.items())
        if not inside:
            out.append((g, -score, -a, " ".join(p).encode(), left, right, score, a))
    result, rank = [], Counter()
    for g, _, _, phrase, left, right, score, a in sorted(out):
        rank[g] += 1
        if rank[g] <= top:
            result.append((g, rank[g], phrase.decode(), a, left, right, total[g], score))
    return sorted(result)


def mined(table, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in X.collocations(table, **kw).collect())


def sample(seed=1, n=120):
    r = random.Random(seed)
    words = ["new", "york", "City", "of", "the", "big", "apple", "Éa", "漢", "x-y", "a\x0bb", "long" * 9]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", "! "]) for _ in range(r.randint(0, 30)))
        if i % 3 == 0:
            text += " new york city the big apple"
        rows.append((i, text, r.choice(["en", "en", "de", None, "und"]), "s"))
    return rows + [(None, None, None, None), (5, "", "en", "s"), (7, "a b", "xx", "s"), (7, "a b", "xx", "s")]


def test_equals_plain_counting(spark):
    rows = sample()
    table = docs(spark, rows).selectExpr("*", "1 as pos", "2 as word", "3 as n")  # clashing names
    want = brute(rows)
    assert len(want) > 8 and mined(table) == want


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths_and_limits(spark, longest):
    rows = sample(2, 60)
    assert mined(docs(spark, rows), least=5, longest=longest, top=12) == brute(rows, 5, longest, 12)


def test_without_broadcasts(spark, monkeypatch):
    """Lookups too large to broadcast: heavy keys and shuffles give the same rows."""
    rows = sample(3, 60) + [(i, "hot " * 40, "en", "s") for i in range(20)]
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HEAVY_ROWS", 30)
    assert mined(docs(spark, rows)) == brute(rows)


def test_pieces_and_ties(spark):
    rows = [(i, "a b. c d\ta,b c!D a", "en", "s") for i in range(10)]
    assert mined(docs(spark, rows)) == brute(rows)


def test_large_counts_are_exact(spark):
    big = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long")
    a, left, right = (f"cast({c} as decimal(38,0))" for c in "alr")
    got = big.selectExpr(f"(cast(1000000 as decimal(38,0)) * ({a} * {a})) div ({left} * {right}) as s").first()["s"]
    assert got == 1000000 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_000)


def test_merge_join_needs_no_shuffle(spark):
    """Stored relations meet bucket by bucket: the plan of the join has a sort-merge join and no exchange below it."""
    relations = X._Relations(spark)
    try:
        words = X.word_rows(docs(spark, sample()), relations.buckets)
        table = relations.store(words.selectExpr("doc", "pos", "xxhash64(word) as w1"))
        after = table.selectExpr("doc as d", "pos as p", "w1 as w2")
        joined = table.join(after.hint("merge"), (table["doc"] == after["d"]) & (table["pos"] + 1 == after["p"]))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # the caller's session is as it was
    finally:
        relations.drop()


def test_empty_and_rare(spark):
    assert mined(docs(spark, [])) == [] and mined(docs(spark, [(1, "one two three", "en", "s")])) == []


def test_occurrences_are_packed_in_blocks(spark, monkeypatch):
    """The stored relation has a row per block, not per word, with the words and neighbours of the plain relation."""
    long = "x" * 70
    rows = sample(4, 200) + [(i, f"{long}a {long}b, é{long} a\0 a b", "fr", "s") for i in range(3)]
    got, pairs, n = Counter(), Counter(), 0
    for block in X.word_blocks(docs(spark, rows)).collect():
        sizes = np.frombuffer(block["sizes"], np.int32)
        stop = np.cumsum(sizes)
        words = [block["letters"][b - s : b].decode() for s, b in zip(sizes.tolist(), stop.tolist())]
        codes = np.frombuffer(block["codes"], np.int32).tolist()
        assert np.frombuffer(block["counts"], np.int64).tolist() == [codes.count(i) for i in range(len(words))]
        got.update((block["lang"], words[c]) for c in codes if c >= 0)
        pairs.update((block["lang"], words[a], words[b]) for a, b in zip(codes, codes[1:]) if a >= 0 and b >= 0)
        n += 1
    plain = {(r["doc"], r["pos"]): (r["lang"], r["word"]) for r in X.word_rows(docs(spark, rows)).collect()}
    assert got == Counter(plain.values()) and n <= 4 * len({g for g, _ in got})
    assert pairs == Counter((g, w, plain[d, i + 1][1]) for (d, i), (g, w) in plain.items() if (d, i + 1) in plain)


def test_word_ids_tell_words_apart():
    words = [b"a" * n for n in range(1, 140)] + [b"a\0", b"a\0\0", b"b" * 64, b"b" * 63 + b"c", "\u00e9".encode()]
    sizes = np.array([len(w) for w in words], np.int32)
    for langs in (X._lang_hash("en", 0), X._lang_hash("de", 0), X._lang_hash("en", 1)):
        ids = X.word_ids(b"".join(words), sizes, langs)
        assert len(set(ids.tolist())) == len(words)
        assert X.word_ids(words[7], sizes[7:8], langs)[0] == ids[7] and X.word_ids(words[99], sizes[99:100], langs)[0] == ids[99]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BYTES", 10)
    for text in (b"", b"a b", b"a b. c d e f g h i j k l. m", b"abcdefghijklmnop", b"aaaaaaaaaaaaaaaa, b c d e; f"):
        parts = list(X._parts(text))
        assert b"".join(parts) == text and all(p[-1:] in (b".", b",", b";") for p in parts[:-1])


def test_phrases_of_a_block_are_counted_exactly_with_any_number_of_words():
    """Keys of three words of 2 ** 21 do not fit into 63 bits."""
    codes = np.array([2**21 - 1, 5, 2**21 - 2, -1, 2**21 - 1, 5, 2**21 - 2, 5, 2**21 - 2, -1], np.int32)
    for size, at in ((2**21, [0, 4, 5, 6]), (2**20, [])):
        block = X._Block({"codes": codes.tobytes(), "ids": np.arange(size, dtype=np.uint64).tobytes()})
        want = Counter(tuple(codes[i : i + 3].tolist()) for i in at)
        assert {tuple(c[:3]): c[3] for c in block.counted(np.array(at, np.int64), 3).T.tolist()} == want
