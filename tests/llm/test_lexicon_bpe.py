"""BPE through the transducer of frequent words, against the public library and brute force."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankwell.llm import lexicon_bpe as X
from tests.llm.helpers import by, docs

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def merges():
    with open(FILE, "rb") as f:
        return X.Merges(f.read())


def test_split_rule_equals_the_library_for_every_code_point(library):
    find, ascii_find = X.split_rules()["any"].findall, X.split_rules()["ascii"].findall
    for block in range(0, 0x110000, 16):
        chars = [chr(cp) for cp in range(block, block + 16) if not 0xD800 <= cp <= 0xDFFF]
        s = "".join(f"a{c}b1{c}2!{c}{c} x  {c} y{c}\nq" for c in chars)
        want = [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]
        assert find(s) == want, hex(block)
    s = "".join(f"a{chr(c)}b1{chr(c)}2!{chr(c)}{chr(c)} x  {chr(c)} y{chr(c)}q" for c in range(128))
    assert ascii_find(s) == find(s)


def test_lexicon_holds_its_words_and_nothing_else():
    r = random.Random(1)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 7))) for _ in range(400)})
    entries = [(w, [i, i * 7 % 11]) for i, w in enumerate(words)]
    lexicon = X.Lexicon(X.to_bytes(X.compile_lexicon(entries)))
    asked = words + [w + b"x" for w in words] + [w[:-1] for w in words] + [b""]
    got = lexicon.numbers(asked).tolist()
    assert got == [words.index(w) if w in set(words) else -1 for w in asked]
    assert all(struct.unpack("<2I", lexicon.ids_of(i)) == tuple(ids) for i, (_, ids) in enumerate(entries))


def test_lexicon_is_minimal():
    """As many states as there are different sets of ends over all prefixes."""
    r = random.Random(2)
    words = {bytes(r.choice(b"ab") for _ in range(r.randint(1, 6))) + b"ing" for _ in range(60)}
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    ends = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    made = X.compile_lexicon((w, [1]) for w in words)
    assert len(made["final"]) == len(ends)


def test_empty_lexicon():
    lexicon = X.Lexicon(X.to_bytes(X.compile_lexicon([])))
    assert lexicon.numbers([b"a", b""]).tolist() == [-1, -1]


def test_file_is_mapped_into_memory(tmp_path, merges):
    path = tmp_path / "lexicon.bin"
    path.write_bytes(X.to_bytes(X.compile_lexicon([(b" the", merges.merge(b" the"))])))
    lexicon = X.Lexicon(str(path))
    assert isinstance(lexicon.arcs.base if lexicon.arcs.base is not None else lexicon.arcs, np.memmap)
    assert lexicon.numbers([b" the", b" th"]).tolist() == [0, -1]


def test_merging_equals_the_library(merges, library):
    r = random.Random(3)
    words = [" " * r.randint(0, 1) + "".join(r.choice("abcdeinorstéж漢😀") for _ in range(r.randint(1, 30))) for _ in range(500)]
    words += ["a" * n for n in range(1, 150)] + ["ab" * 200, "é" * 500, "漢" * 90]
    for w in words:
        ids = merges.merge(w.encode())
        assert ids == [i for p in X.split_rules()["any"].findall(w) for i in merges.merge(p.encode())] or len(X.split_rules()["any"].findall(w)) > 1
        if len(X.split_rules()["any"].findall(w)) == 1:
            assert ids == library.encode(w, add_special_tokens=False).ids
    short = [w.encode() for w in words if len(w.encode()) <= 64]
    assert merges.merge_many(short) == [struct.pack(f"<{len(i)}I", *i) for i in map(merges.merge, short)]
    assert merges.merge_many([b"", b"a", b""])[0] == b""


def texts():
    r = random.Random(4)
    letters = "aeinrst  \t\n'.,!?019éßж漢字ा😀  \U00016d40"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(120)]
    out += ["the cat's hat, they're we'll I'd", "<|endoftext|>a <|endoftext|><|endoftext|> b<|endoftext", " ", "  x  ", "x\n\n y", "", "a" * 3000]
    return out


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_documents_equal_the_library(spark, library):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())] + [(None, None, None, None), (3, "again", None, "s"), (3, "again", None, "s")]
    rows += [(1000 + i, "frequent words of this corpus are in the lexicon", "en", "s") for i in range(20)]
    table = docs(spark, rows).selectExpr("*", "1 as n_tokens", "'x' as ids", "'y' as word")  # clashing names
    got = by(X.encode_documents(table, FILE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = sorted(((i, *expected(library, t)) for i, t, *_ in rows), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
    assert got == want


def test_ids_on_request(spark, library):
    got = X.encode_documents(docs(spark, [(1, "to be or not", "en", "s")]), FILE, with_ids=True).first()
    assert got["ids"] == library.encode("to be or not").ids


def test_long_text_is_cut_between_words(monkeypatch, library, merges):
    monkeypatch.setattr(X, "SLICE", 50)
    text = "some words and, 12 numbers;漢字 más   spaces 's " * 60 + "z" * 500
    coder = X.LexiconBPE(merges, X.Lexicon(X.to_bytes(X.compile_lexicon([]))))
    assert len(list(X.words_of(text))) > 5
    ids = np.frombuffer(b"".join(i for _, i in coder.encode_all([text])), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_memo_generations_keep_results(library, merges):
    coder = X.LexiconBPE(merges, X.Lexicon(X.to_bytes(X.compile_lexicon([]))), memo=5)
    for _ in range(2):
        for t in texts():
            got = np.frombuffer(b"".join(i for _, i in coder.encode_all([t])), "<u4").tolist()
            assert got == library.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    assert X.encode_documents(docs(spark, []), FILE).collect() == []


def test_frequent_words_are_counted_over_all_texts(spark):
    table = docs(spark, [(i, "alpha beta. alpha", "en", "s") for i in range(6)] + [(9, None, None, None)])
    got = {r["word"]: r["n"] for r in X.count_words(table).collect()}
    assert got == {" alpha": 12, " beta": 6}
    assert [r["word"] for r in X.frequent_words(table).collect()] == [" alpha"]
    assert X.frequent_words(table, 0).collect() == []
