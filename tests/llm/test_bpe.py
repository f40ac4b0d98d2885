import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from rankwell.llm import bpe
from tests.llm.helpers import docs

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = bpe.parse_ranks(DATA)


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_equal_the_public_library(public):
    coder, r = bpe.PrefixBPE(RANKS), random.Random(3)
    for n in range(1500):
        alphabet = bytes(range(256)) if n % 2 else b"aab the\xc3\xa9in'!  1tion"
        piece = bytes(r.choice(alphabet) for _ in range(r.randint(1, 90)))
        ids = coder.encode_piece(piece)
        assert ids == public._encode_single_piece(piece)
        assert coder.decode(ids) == piece


def test_appends_and_edits_equal_encoding_anew():
    coder, r = bpe.PrefixBPE(RANKS), random.Random(4)
    for _ in range(60):
        base = bytes(r.choice(b"the in er on tion s") for _ in range(r.randint(0, 400)))
        table = bpe.Prefixes(coder, base)
        table.append(b"ing the")
        assert table.ids() == coder.encode_piece(base + b"ing the")
        a = r.randint(0, len(base))
        b = min(len(base), a + r.randint(0, 6))
        table.replace(a, b, b"xy")
        assert table.ids() == coder.encode_piece(base[:a] + b"xy" + base[b:] + b"ing the")


def test_an_edit_recomputes_only_a_part():
    table = bpe.Prefixes(bpe.PrefixBPE({k: v for k, v in RANKS.items() if len(k) <= 8}), b"the cat sat on the mat " * 200)
    assert table.replace(20, 21, b"Q") < 200


def test_memo_is_bounded_and_harmless(public):
    coder = bpe.TextBPE(RANKS, P.PATTERN, memo=10)
    coder.bpe.memo = 10
    text = " ".join(f"word{i} thing{i % 7}" for i in range(200))
    assert coder.encode(text)[0] == public.encode_ordinary(text)


def test_edge_rows(spark, public):
    long = "ab" * 40_000 + " " + "x" * 3000 + "é" * 500
    rows = [(1, None), (2, ""), (3, "Hi there"), (3, "Hi there"), (None, " \n\n  a"), (5, long), (6, "<|endoftext|>")]
    got = bpe.encode_documents(docs(spark, rows).withColumnRenamed("lang", "ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    want = {t or "": public.encode_ordinary(t or "") for _, t in rows}
    for r in got:
        text = next((t or "") for i, t in rows if i == r.doc_id)
        if r.doc_id in (1, 2):
            assert r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() == r.decoded_sha256
        assert r.ids == want[text] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_documents(docs(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_query_against_the_public_library(spark, public):
    got = {r.doc_id: r for r in bpe.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = public.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
