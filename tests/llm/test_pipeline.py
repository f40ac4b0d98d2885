"""The pipeline against a plain Python version of it, stage by stage."""

import hashlib
from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import tiktoken

from rankwell.llm import bpe, mixing, simhash
from rankwell.llm import toxicity as T
from tests.llm.helpers import components, docs

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "byte_bpe"]


def test_every_stage_against_plain_python(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = T.trained(spark, SF)
    rows = rows_of(documents)

    def margin(text):
        words = sorted(T.words_of(text))
        return max(model.margins(words)) if words else -model.bias

    want = [r for r in rows if model is None or model.score(margin(r[1])) < 0.5]
    stage = dict(P.STAGES)
    df = stage["toxicity"](spark, documents, SF)
    assert df.columns == documents.columns and rows_of(df) == want

    last = {}
    for r in want:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        last[key] = max(last.get(key, r), r)
    want = sorted(last.values())
    df = stage["exact_dedup"](spark, df, SF)
    assert df.columns == documents.columns and rows_of(df) == want

    f = np.array([simhash.fingerprint(r[1].encode()) for r in want], dtype=np.uint64)
    links = [(i, j) for i in range(len(f)) for j in range(i) if int(np.bitwise_count(f[i] ^ f[j])) <= 4]
    root = components(len(f), links)  # rows are in order of their ids
    want = [r for i, r in enumerate(want) if root[i] == i]
    df = stage["simhash"](spark, df, SF)
    assert df.columns == documents.columns and rows_of(df) == want

    size = defaultdict(int)
    for r in want:
        size[r[3]] += len(r[1].split())
    mixed = mixing.mix(mixing.sized_documents(docs(spark, [r[:4] for r in want]))).collect()
    taken = {r.doc_id: r.taken for r in mixed}
    copies = []
    for r in want:
        n, left = len(r[1].split()), taken[r[0]]
        while left > 0:
            copies.append((r[0], min(n, left), r[3]))
            left -= n
    out = stage["mixing"](spark, df, SF)
    got = out.collect()
    assert out.columns == documents.columns
    assert sorted((r.doc_id, len(r.text.split()), r.source) for r in got) == sorted(copies)
    full = {r[0]: r[1] for r in want}
    assert all(full[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)

    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = stage["byte_bpe"](spark, out, SF)
    ids = lambda t: hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in final.collect()) == sorted((r.doc_id, ids(r.text)) for r in got)
    assert rows_of(P.run(spark, SF)) == rows_of(final)


def test_stages_on_edge_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "Same text here", "en", "a"), (4, "same TEXT here", None, "a"), (5, "x " * 20_000, "en", None), (5, "x " * 20_000, "en", None), (None, "no id at all", "de", "b")]
    df = docs(spark, rows)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        out.collect()
    empty = docs(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == [], name


def test_entry_registers_all_queries():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
