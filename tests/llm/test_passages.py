import random
from collections import Counter
from itertools import combinations

import numpy as np

from rankwell.llm import passages as P
from tests.llm.helpers import components, docs

R = random.Random(9)
VOCABULARY = [f"w{i}" for i in range(4000)] + ["the"] * 500


def words(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def spans(spark, rows):
    return P.repeated_passages(docs(spark, rows)).collect()


def test_subset_keys_are_exact():
    """Two paragraphs share a key exactly if the multisets of their shingles are similar enough."""
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 40, 12).astype(np.uint64)
        b = a.copy()
        for _ in range(r.integers(0, 4)):
            b[r.integers(0, 12)] = r.integers(0, 40)
        count = lambda x: {(int(v), k) for v in set(x.tolist()) for k in range((x == v).sum())}
        x, y = count(a), count(b)
        assert bool(set(P.subset_keys(a)) & set(P.subset_keys(b))) == (len(x & y) / len(x | y) >= 0.8)


def is_subsequence_of_all_but_one(a, b):
    """Whether all but one word of a stand in b in the same order, and the other way round."""
    return any(a[:i] + a[i + 1 :] == b[:j] + b[j + 1 :] for i in range(len(a)) for j in range(len(b)))


def similar(a, b):
    x, y = (Counter(tuple(w[i : i + P.SHINGLE]) for i in range(len(w) - P.SHINGLE + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values()) >= 0.8


def test_deletion_keys_are_exact():
    r = np.random.default_rng(2)
    hits = 0
    for n in range(600):
        a = r.integers(0, 3 if n % 2 else 50, 16).tolist()
        b = list(a)
        for _ in range(r.integers(0, 3)):
            i = int(r.integers(0, 16))
            b = [b[:i] + [99] + b[i + 1 :], (b[:i] + [98] + b[i:])[:16], b[:i] + b[i + 1 :] + [97]][r.integers(0, 3)]
        keys = [set(P.deletion_keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert bool(keys[0] & keys[1]) == is_subsequence_of_all_but_one(a, b)
        hits += bool(keys[0] & keys[1])
    assert 200 < hits < 600


def test_near_keys_are_exact():
    """Two paragraphs share a key exactly if one word or at most a fifth of their shingles makes the difference."""
    r = np.random.default_rng(4)
    turned = 0
    for n in range(800):
        a = r.integers(0, (2, 4, 60)[n % 3], 16).tolist()
        if n % 5 == 0:  # begins and ends alike: its shingles can stand in another order
            a[13:] = a[:3]
            i = int(r.integers(1, 11))
            b = a[i + 1 :] + a[3 : i + 4]
        else:
            b = list(a)
            for _ in range(r.integers(0, 3)):
                b[r.integers(0, 16)] = int(r.integers(0, 60))
        keys = [set(P.near_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        one, sets = is_subsequence_of_all_but_one(a, b), similar(a, b)
        assert bool(keys[0] & keys[1]) == (one or sets)
        turned += sets and not one
    assert turned > 20


def test_every_passage_of_over_50_words_has_a_common_paragraph():
    """Winnowing: a copy of WORDS + REACH - 1 words has an anchor that all copies have."""
    assert P.WORDS + P.REACH - 1 == 51
    for n in [51] * 600:
        passage = words(n)
        before, after = words(R.randint(0, 60)), words(R.randint(0, 60))
        one, two = before + passage + after, words(40) + passage + words(40)
        a, b = (P.paragraphs(" ".join(t).encode()) for t in (one, two))
        assert set(a[3].tolist()) & set(b[3].tolist())
        assert np.diff(a[0]).max(initial=0) <= P.REACH  # the words behind reach the next one


def test_anchors_are_the_least_of_some_window():
    for n in (P.REACH + 2, 50, 300):
        h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        g = P._runs(h, 3).tolist()
        best = {min(range(i, i + P.REACH), key=g.__getitem__) for i in range(len(g) - P.REACH + 1)}
        assert P.anchors(h).tolist() == sorted(best)
    same = P.anchors(np.zeros(5000, np.uint64))
    assert 130 <= len(same) <= 145  # repeated words: one in REACH, not each
    assert len(P.anchors(np.zeros(5, np.uint64))) == 0


def test_lines_are_paragraphs(spark):
    line = words(P.WORDS)
    rows = [(1, " ".join(words(9)) + "\n" + " ".join(line) + "\n" + " ".join(words(25))), (2, " ".join(words(40)) + "\r\n" + " ".join(line) + "\n" + " ".join(words(30)))]
    found = {r.doc_id: r for r in spans(spark, rows)}
    assert {i: dict(rows)[i].encode()[r.start : r.stop].decode().split() for i, r in found.items()} == {1: line, 2: line}


def test_any_changed_word_keeps_the_class(spark):
    """One word of a paragraph replaced, inserted or left out, at every place."""
    rows, want = [], {}
    for i in range(P.WORDS):
        base = words(P.WORDS)
        forms = [base, base[:i] + ["other"] + base[i + 1 :], (base[:i] + ["more"] + base[i:])[: P.WORDS], base[:i] + base[i + 1 :] + ["end"]]
        two = [*base]
        two[i], two[(i + 7) % P.WORDS] = "one", "two"  # two changed inner words are too many
        for k, form in enumerate([*forms, two]):
            rows.append((10 * i + k, " ".join(form)))
            want[10 * i + k] = form
    got = {r.doc_id: r for r in spans(spark, rows)}
    for i in range(P.WORDS):
        replaced = {10 * i, 10 * i + 1}
        assert replaced <= set(got) and len({got[j].class_id for j in replaced}) == 1
        # Words inserted or left out in the second half leave the first one; in the first half they shift the second.
        if i >= P.WORDS // 2:
            assert all(10 * i + k in got and got[10 * i + k].class_id == got[10 * i].class_id for k in (2, 3))
    near = lambda a, b: is_subsequence_of_all_but_one(a, b) or similar(a, b)
    for j in got:
        assert any(near(want[j], want[k]) for k in want if k != j and k // 10 == j // 10)


def brute_force(rows):
    """(doc_id, pos) of repeated paragraphs with their class as a set of digests, over all pairs of paragraphs."""
    units = []
    for doc, text in rows:
        data = text.encode()
        found = P.paragraphs(data)
        if found is None:
            continue
        low = data.lower().split()
        units += [(doc, int(p), int(d), low[p : p + P.WORDS]) for p, d in zip(found[0], found[3])]
    text_of = {u[2]: u[3] for u in units}
    digests = sorted(text_of)
    links = [(i, j) for i, j in combinations(range(len(digests)), 2) if is_subsequence_of_all_but_one(text_of[digests[i]], text_of[digests[j]]) or similar(text_of[digests[i]], text_of[digests[j]])]
    root = dict(zip(digests, components(len(digests), links)))
    holders = {}
    for doc, pos, d, _ in units:
        holders.setdefault(root[d], set()).add((doc, pos))
    return {(doc, pos): root[d] for doc, pos, d, _ in units if len({h[0] for h in holders[root[d]]}) > 1}, holders


def test_spans_and_classes_equal_brute_force(spark):
    rows, shared = [], [words(20), words(60), words(110)]
    for i in range(14):
        text = words(R.randint(8, 30))
        if i % 2 == 0:
            part = list(shared[i % 3])
            if i % 4 == 0:
                part[R.randrange(len(part))] = f"changed{i}"
            text = text + part + words(R.randint(5, 20))
        rows.append((i, " ".join(text)))
    rows += [(20 + i, " ".join(shared[0][:8] + [f"x{i}"] + shared[0][9:16])) for i in range(3)]
    repeated, holders = brute_force(rows)
    got = spans(spark, rows)
    covered = {}
    for r in got:
        text = dict(rows)[r.doc_id].encode()
        first = len(text[: r.start].split())
        covered.setdefault(r.doc_id, []).append((first, first + r.n_words, r.removed))
    low = {doc: text.split() for doc, text in rows}
    for doc, _ in rows:
        mine = sorted(p for d, p in repeated if d == doc)
        for removed in (False, True):
            merged = []
            for p in mine:
                first, at = min(holders[repeated[doc, p]])
                if (first != doc or abs(at - p) >= P.WORDS) == removed:
                    end = p + P.WORDS
                    behind = low[doc][end : end + P.BEHIND]
                    if removed and behind == low[first][at + P.WORDS : at + P.WORDS + P.BEHIND]:
                        end += len(behind)
                    if merged and p <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([p, end])
            assert sorted((a, b) for a, b, x in covered.get(doc, []) if x == removed) == [tuple(m) for m in merged]


def test_copies_of_a_long_passage_are_one_span(spark):
    passage = words(400)
    rows = [(i, " ".join(words(50) + passage + words(50))) for i in range(4)]
    found = [r for r in spans(spark, rows) if r.removed]
    assert [r.doc_id for r in sorted(found)] == [1, 2, 3]
    for r in found:
        part = dict(rows)[r.doc_id].encode()[r.start : r.stop].decode().split()
        assert len(part) == r.n_words >= 400 - 2 * P.REACH and " ".join(part) in " ".join(passage)


def test_rows_without_an_id_stay_apart(spark):
    """Each text of id-less rows has its own list of colliding places and its own spans."""
    base = words(40)
    rows = [(None, " ".join(base[:20] + [f"v{i}"] + base[21:])) for i in range(60)] + [(None, " ".join(base))] * 50 + [(7, " ".join(base))]
    found = spans(spark, rows)
    assert len({r.text_id for r in found}) == 61 and None not in {r.text_id for r in found} and {r.doc_id for r in found} == {None, 7}
    mine = [r for r in found if r.doc_id is None and not r.removed]
    assert len(found) <= 62 * 4 and mine
    assert all(r.first_doc_id is None for r in found)


def test_embedded_passages_are_found(spark):
    rows, planted = [], {}
    for k in range(20):
        passage = words(R.randint(60, 120))
        for _ in range(3):
            i = len(rows)
            rows.append((i, " ".join(words(R.randint(30, 90))) + " " + " ".join(passage) + "\n" + " ".join(words(40))))
            planted.setdefault(k, []).append(i)
    clean = list(range(len(rows), len(rows) + 40))
    rows += [(i, " ".join(words(150))) for i in clean]
    found = spans(spark, rows)
    hit = {r.doc_id for r in found}
    assert hit == {i for ids in planted.values() for i in ids} and not hit & set(clean)
    text = {i: t.encode() for i, t in rows}
    for r in found:
        assert len(text[r.doc_id][r.start : r.stop].split()) == r.n_words >= P.WORDS
        assert r.removed == (r.doc_id != r.first_doc_id)
    # the first document's copy stays
    assert not any(r.removed for r in found if r.doc_id in {min(ids) for ids in planted.values()})


def test_near_paragraphs_share_a_class(spark):
    base = words(16)
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["other"])), (3, " ".join(words(16))), (4, " ".join(base[:8] + ["x", "y", "z"] + base[11:]))]
    found = {r.doc_id: r for r in spans(spark, rows)}
    assert set(found) == {1, 2} and found[1].class_id == found[2].class_id and found[2].removed and not found[1].removed


def test_edge_rows(spark):
    long = " ".join(words(20_000))
    same = " ".join(words(30))
    rows = [(1, None), (2, ""), (3, "too short"), (4, same), (4, same), (5, long), (None, same), (None, same.upper()), (6, "the " * 500), (7, "the " * 300), (8, "  " + same.replace(" ", " \n ") + "\t")]
    found = spans(spark, rows)
    assert {r.doc_id for r in found} == {4, None, 6, 7, 8}
    assert spans(spark, []) == [] and spans(spark, [(1, same), (1, same)]) == []


def test_offsets_are_bytes(spark):
    text = "ä ö  ü\n" + " ".join(f"é{i}" for i in range(40))
    rows = [(1, text), (2, "pre " + text)]
    for r in spans(spark, rows):
        got = dict(rows)[r.doc_id].encode()[r.start : r.stop].decode()
        assert len(got.split()) == r.n_words


def test_clashing_columns(spark):
    same = " ".join(words(40))
    df = docs(spark, [(1, same), (2, same)]).selectExpr("*", "1 as digest", "2 as pos", "3 as removed")
    assert {r.doc_id for r in P.repeated_passages(df).collect()} == {1, 2}


def test_hot_passage_keeps_rows_linear(spark):
    passage = " ".join(words(70))
    rows = [(i, " ".join(words(20)) + " " + passage + " " + " ".join(words(20))) for i in range(300)]
    found = spans(spark, rows)
    assert {r.doc_id for r in found} == set(range(300)) and len(found) <= 4 * 300


def test_texts_taken_apart_together_are_as_each_alone(monkeypatch):
    """Whatever texts stand beside each other, and words are hashed once per group, not once per text."""
    import pyarrow as pa

    r = random.Random(31)
    texts = ["", " ", None, "a", "\t".join(["x"] * 60), "z " * 400, "\x0b\x0cé ü\r\n" * 30, ""]
    for n in range(150):
        texts.append("".join(r.choice(["a", "B", "cc"] + VOCABULARY[:40]) + r.choice([" ", "  ", "\n", "\t", " \n "]) for _ in range(n)))
    r.shuffle(texts)
    hashed = []
    real = P.word_hashes
    monkeypatch.setattr(P, "word_hashes", lambda words: (hashed.append(len(words)), real(words))[1])
    monkeypatch.setattr(P, "GROUP_BYTES", 4000)
    column = pa.array([None if t is None else t.encode() for t in texts])
    together = []
    for first, group in P.text_groups(column):
        found = P.text_paragraphs(group)
        if found is not None:
            together += [(int(first + text), *map(int, row)) for text, *row in zip(*found)]
    assert len(hashed) < len(texts) / 3 and sum(hashed) < sum(len((t or "").split()) for t in texts) / 2
    alone = []
    for i, t in enumerate(texts):
        found = P.paragraphs((t or "").encode())
        alone += [] if found is None else [(i, *map(int, row)) for row in zip(*found)]
    assert together == alone and len(together) > 200
