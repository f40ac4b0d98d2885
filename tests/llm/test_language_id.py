import numpy as np

from rankwell.llm import language_id as L
from tests.llm.helpers import crc, docs

SAMPLES = {"en": " the house is over there and this thing with that ", "de": " das haus ist dort und dieses ding mit dem schön ", "xx": " zzz "}


def slow_phrases(sample, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_substring_search():
    parser = L.CrossParser(SAMPLES)
    words = ["the", "there", "thing", "haus", "schön", "qqq", "z", "overthe", "ßx", "日本"]
    bits = parser.bits(words)
    for i, w in enumerate(words):
        for k, lang in enumerate(parser.langs):
            assert bits[i, k] == slow_phrases(SAMPLES[lang], f" {w} ") * parser.pointer[k]


def test_memo_is_bounded():
    a, b = L.CrossParser(SAMPLES, memo=3), L.CrossParser(SAMPLES)
    texts = [f"the {w} das" for w in ("house", "ding", "thing", "mit", "over")] * 3
    assert [a.predict([t])[0] for t in texts] == b.predict(texts)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 .. ²"), (4, "the house"), (4, "the house"), (None, "Das Haus"), (6, "das ding " * 40_000), (7, "x" * 100_000)]
    out = L.identify(docs(spark, rows).withColumnRenamed("lang", "lang_pred"), SAMPLES).collect()
    got = sorted(((str(r.doc_id), r.lang_pred) for r in out))
    assert [g for g in got if g[0] != "7"] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("6", "de"), ("None", "de")]
    assert all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.lang_pred == "und"} == {0.0}
    assert L.identify(docs(spark, []), SAMPLES).collect() == []
    assert {r.lang_pred for r in L.identify(docs(spark, rows), {}).collect()} == {"und"}


def test_samples_leave_out_null_languages(spark):
    df = docs(spark, [(1, "alpha beta", "a"), (2, "gamma", None), (3, None, "b"), (4, "delta 12", "b")])
    assert L.language_samples(df) == {"a": " alpha beta ", "b": " delta "}
    assert L.language_samples(docs(spark, [])) == {}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = L.op2_language_id(spark, sf)
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert len(rows) == len(want) and all(r.held_out == (crc(r.doc_id, 3) == 1) for r in rows)
    held = [r.lang_pred == want[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97
