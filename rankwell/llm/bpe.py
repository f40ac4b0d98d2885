"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are: no merge across their border comes before the merges that made
them.  So each prefix of a byte string has one valid last token, and the table
of last tokens of all prefixes (a) extends byte by byte, exactly, and (b) gives
the encoding by walking back.  After an edit only the entries from the edit on
are recomputed, until the table agrees with the old one over a span as long as
the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rankwell.llm.common import documents, prepare

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and decimal rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBPE:
    """Encoder and decoder over a rank table; memos are bounded by ``memo`` entries."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.ranks, self.memo = ranks, memo
        self.tokens = {t: b for b, t in ranks.items()}
        self.longest = max(map(len, ranks))
        # Length of the longest token that ends with three bytes: most positions need few candidates.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > self.reach.get(b[-3:], 2):
                self.reach[b[-3:]] = len(b)
        self._parts: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._last: dict[bytes, int] = {}

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; (-1, -1) for single bytes."""
        found = self._parts.get(token)
        if found is None:
            b, found = self.tokens[token], (-1, -1)
            for i in range(1, len(b)):
                p, q = self.ranks.get(b[:i], token), self.ranks.get(b[i:], token)
                if p < token and q < token and self._border(p, q, token):
                    found = (p, q)
                    break
            self._parts[token] = found
        return found

    def _border(self, p: int, q: int, limit: float) -> bool:
        """True if no merge of rank under ``limit`` crosses the border of p and q.

        Goes back in time: undo whichever of the two border tokens was made last;
        a merge across the border would have won if its rank is lower than that one's
        (at the right of the border also if it is equal, as the leftmost goes first).
        """
        tokens, rank, parts, split = self.tokens, self.ranks.get, self._parts, self._split
        while True:
            across = rank(tokens[p] + tokens[q])
            if across is not None and across < limit:
                return False
            left = (parts.get(p) or split(p))[1]
            right = (parts.get(q) or split(q))[0]
            if left < 0 and right < 0:
                return True
            if right < 0 or (left >= 0 and p > q):
                limit, p = p, left
            else:
                limit, q = q + 1, right

    def fits(self, p: int, q: int) -> bool:
        """Whether q may follow p in an encoding."""
        known = self._fits.get(p << 20 | q)
        if known is None:
            if len(self._fits) >= self.memo:
                self._fits.clear()
            known = self._fits[p << 20 | q] = self._border(p, q, float("inf"))
        return known

    def extend(self, piece: bytes, last: list[int], start: int) -> None:
        """Fill ``last[i]``, the last token of ``piece[:i]``, for i over ``start``, in place."""
        rank, known, reach = self.ranks.get, self._fits, self.reach.get
        for i in range(start + 1, len(piece) + 1):
            far = reach(piece[i - 3 : i], 2) if i > 3 else i
            for k in range(i - far if i > far else 0, i):
                token = rank(piece[k:i])
                if token is not None:
                    if not k:
                        break
                    fit = known.get(last[k] << 20 | token)
                    if fit or (fit is None and self.fits(last[k], token)):
                        break
            else:
                raise ValueError("the rank table does not cover every byte")
            last[i] = token

    def walk(self, last: list[int], end: int) -> list[int]:
        ids = []
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern.  Short pieces share a memo of prefix entries."""
        n = len(piece)
        if n > 48:
            last = [0] * (n + 1)
            self.extend(piece, last, 0)
            return self.walk(last, n)
        memo = self._last
        if len(memo) >= self.memo:
            memo.clear()
        last = [0] * (n + 1)
        known = n
        while known and piece[:known] not in memo:
            known -= 1
        for i in range(known, 0, -1):
            if (token := memo.get(piece[:i])) is None:  # cleared in between
                known = 0
                break
            last[i] = token
        self.extend(piece, last, known)
        for i in range(known + 1, n + 1):
            memo[piece[:i]] = last[i]
        return self.walk(last, n)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """Encoding of one byte string that grows or is edited."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self.last += [0] * len(more)
        self.bpe.extend(self.piece, self.last, start)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..end; returns how many entries were recomputed.

        Entries up to ``start`` stay.  From there on they are recomputed, until
        as many in a row as the longest token equal the old ones: then all later ones do.
        """
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last = old[: start + 1] + [0] * (len(self.piece) - start)
        run = 0
        for i in range(start + 1, len(self.piece) + 1):
            self.bpe.extend(self.piece[:i], last, i - 1)
            run = run + 1 if i > start + len(new) and last[i] == old[i - shift] else 0
            if run >= self.bpe.longest:
                last[i + 1 :] = old[i - shift + 1 :]
                self.last = last
                return i - start
        self.last = last
        return len(self.piece) - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last, len(self.piece))


class TextBPE:
    """Whole texts: each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.bpe, self.find, self.memo = PrefixBPE(ranks), regex.compile(pattern).findall, memo
        self._new: dict[str, tuple[tuple[int, ...], str]] = {}
        self._old: dict[str, tuple[tuple[int, ...], str]] = {}

    def piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Ids of a match, and the same as text; two generations of a memo keep the frequent ones."""
        found = self._old.get(piece)
        if found is None:
            ids = tuple(self.bpe.encode_piece(piece.encode("utf-8")))  # a tuple of numbers costs the garbage collector nothing
            found = (ids, " ".join(map(str, ids)))
        if len(piece) <= 32:
            if len(self._new) >= self.memo:
                self._old, self._new = self._new, {}
            self._new[piece] = found
        return found

    def encode(self, text: str) -> tuple[list[int], str]:
        pieces = self.find(text)
        found = list(map(self._new.get, pieces))
        if not all(found):
            found = [f or self.piece(p) for f, p in zip(found, pieces)]
        if not found:
            return [], ""
        ids, shown = zip(*found)
        return list(chain.from_iterable(ids)), " ".join(shown)


_CODERS: dict[tuple[str, str], TextBPE] = {}


def _coder(data: bytes, pattern: str) -> TextBPE:
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TextBPE(parse_ranks(data), pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of (doc_id, text); ``with_ids`` adds the ids.

    The rank file is read by the driver and broadcast (it is a vocabulary, under
    a few MB whatever the corpus).  A null text counts as empty: no ids, and the
    digests of no bytes.  Rows are independent: no shuffle, and a lost task is
    simply run again.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                ids, shown = coder.encode(text.as_py() or "")
                decoded = coder.bpe.decode(ids)
                out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if with_ids else None))
            cols = [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([o[3] for o in out], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public byte-level vocabulary."""
    import public_tokenizers

    prepare(spark)
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
