import numpy as np
from pyspark.sql import functions as F

from rankwell.llm import toxicity as T
from tests.llm.helpers import crc, docs

SF = "/root/testdata/sf0.1"


def slow_kernel(a, b, decay=0.5):
    """Common gapped subsequences of three (span 5) and four (span 6) characters, straight from the definition."""
    from itertools import combinations

    def counts(w):
        s, out = f"^{w}^", {}
        for n, span in ((3, 5), (4, 6)):
            for at in combinations(range(len(s)), n):
                if at[-1] - at[0] < span:
                    key = "".join(s[i] for i in at)
                    out[key] = out.get(key, 0) + decay ** (at[-1] - at[0] + 1 - n)
        return out

    x, y = counts(a), counts(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_against_the_definition():
    words = ["idiot", "idxiot", "idiots", "banana", "ananas", "scum", "ab", "a"]
    k = T.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - slow_kernel(a, b)) < 1e-5


def test_words():
    assert T.words_of(None) == T.words_of(" 12 !!") == set()
    assert "idiot" in T.words_of("you i d i o t there") and "id-iot" in T.words_of("(id-iot)!!")
    assert sorted(T.windows("id-iot")) == ["id-iot", "idiot", "iot"]
    assert all(len(w) <= T.WINDOW for w in T.windows("x" * 100_000)) and "".join(T.windows("abcdefghijklmnopqrstu"))


def model():
    clean = ["house", "garden", "street", "window", "letter", "summer", "people", "number", "answer", "moment", "ideal", "report", "idiom"]
    return T.fit_words({"idiot": 5, "moron": 4, "scum": 3}, clean, ["idiom"], landmarks=24)


def test_gapped_and_inserted_characters_are_tolerated():
    m = model()
    margin = dict(zip(ws := ["idiot", "id.iot", "idxiot", "iddiot", "idiots", "mor-on", "idiom", "flower", "season"], m.margins(ws)))
    for bad in ("idiot", "id.iot", "idxiot", "iddiot", "idiots", "mor-on"):
        assert margin[bad] > max(margin["idiom"], margin["flower"], margin["season"])


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "you idiot"), (4, "you idiot"), (None, "a nice garden"), (6, "house " * 30_000 + "moron")]
    out = T.score(docs(spark, rows), model()).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    empty = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert {r.doc_id for r in out if r.predicted} == {4, 6}
    kept = T.keep_clean(docs(spark, rows).withColumn("score", F.lit("clash")), model())
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"] and kept.columns[-1] == "score"
    assert T.score(docs(spark, []), model()).collect() == []


def test_nothing_learned(spark):
    rows = [(1, "some words"), (2, None)]
    labels = "doc_id long, toxic int"
    assert T.train(docs(spark, rows), spark.createDataFrame([], labels)) is None
    assert T.train(docs(spark, []), spark.createDataFrame([(1, 1), (2, 0)], labels)) is None
    assert [(r.score, r.predicted) for r in T.score(docs(spark, rows), None).collect()] == [(0.0, 0)] * 2
    assert T.keep_clean(docs(spark, rows), None).count() == 2
    assert T.train(docs(spark, rows), spark.createDataFrame([(1, 0), (2, 1), (None, 1), (1, None)], labels)) is None


def test_held_out_accuracy(spark):
    out = T.op1_toxicity(spark, SF).cache()
    assert set(out.columns) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in out.select("doc_id", "held_out").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.94
    assert sum(r.predicted and not r.toxic for r in held) <= 0.05 * len(held)


def test_held_out_rows_are_not_learned_from(spark):
    df = docs(spark, [(i, f"text {i}") for i in range(200)])
    assert {r.doc_id for r in T.learnable(df).collect()} == {i for i in range(200) if crc(i, 5)}


def test_characters_that_are_no_letters():
    """Superscripts, fractions and Roman numerals are word characters but no letters."""
    assert T.windows("km²") == ["km²"] and T.windows("h₂o") == ["h₂o"] and set(T.windows("co₂idiot")) == {"co₂idiot", "coidiot", "idiot"}
    for w in ("cm³", "ⅷⅷⅷ", "½½½", "x²" * 50, "idiot²"):
        assert T.windows(w)


def test_rows_with_characters_that_are_no_letters(spark):
    rows = [(1, "an area of 5 km² of H₂O"), (2, "CO₂ ½½½ Ⅷ"), (3, None), (4, "you vile scum²")]
    model = T.fit_words({"scum": 3, "vile": 2}, ["area", "water", "km²"], ["h₂o"])
    assert {r.doc_id for r in T.score(docs(spark, rows), model).collect()} == {1, 2, 3, 4}
