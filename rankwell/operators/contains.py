"""Substring containment join: which documents contain which passages.

Passages are packed into byte-bounded blocks and paired with document chunks
(``operators.blocks``); each pair row runs one Aho-Corasick automaton over the
chunk's texts, so the cost is linear in the text plus the matches, never one
test per (document, passage) pair.  The automaton of a block is built once per
task and reused for every chunk of that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import n_blocks_for, pack_blocks, pack_partitions, pair_blocks, spread

DEFAULT_BLOCK_BYTES = 8 << 20
# Automata that one task keeps at a time.
MAX_AUTOMATA = 8


def _automaton(patterns: list[str | None]):
    """(automaton or None, passage numbers by text, numbers of empty passages)."""
    import ahocorasick

    by_text: dict[str, list[int]] = {}
    empty: list[int] = []
    for i, p in enumerate(patterns):
        if p is None:
            continue
        if p == "":
            empty.append(i)
        else:
            by_text.setdefault(p, []).append(i)
    auto = None
    if by_text:
        auto = ahocorasick.Automaton()
        for text in by_text:
            auto.add_word(text, text)
        auto.make_automaton()
    return auto, by_text, empty


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automata: dict[int, tuple] = {}  # of this task: its blocks all come from one passage table
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            p_fields = row.column("p_items").flatten().flatten()
            d_fields = row.column("d_items").flatten().flatten()
            pids = p_fields[0].to_pylist()
            blk = row.column("blk")[0].as_py()
            if blk not in automata:
                if len(automata) >= MAX_AUTOMATA:
                    automata.clear()
                automata[blk] = _automaton(p_fields[1].to_pylist())
            auto, by_text, empty = automata[blk]
            out_p, out_d = [], []
            for did, text in zip(d_fields[0], d_fields[1]):  # one text after another becomes a Python object
                did, text = did.as_py(), text.as_py()
                if text is None:
                    continue
                for j in empty:
                    out_p.append(pids[j])
                    out_d.append(did)
                if auto is None:
                    continue
                found = {m for _, m in auto.iter(text)}
                for m in found:
                    for j in by_text[m]:
                        out_p.append(pids[j])
                        out_d.append(did)
            if out_p:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_p, pa.string()), pa.array(out_d, pa.string())], names=["pid", "did"]
                )


def contains_pairs(
    docs: DataFrame,
    passages: DataFrame,
    did: str = "did",
    doc_text: str = "text",
    pid: str = "pid",
    passage_text: str = "text",
    block_bytes: int = DEFAULT_BLOCK_BYTES,
) -> DataFrame:
    """``(pid, did)`` for every document whose text contains the passage text."""
    p = passages.select(F.col(pid).cast("string").alias("pid"), F.col(passage_text).alias("ptext"))
    d = docs.select(F.col(did).cast("string").alias("did"), F.col(doc_text).alias("dtext"))
    total = int(p.agg(F.coalesce(F.sum(F.length("ptext") * 4 + 32), F.lit(0))).first()[0])
    nb = n_blocks_for(total, block_bytes)
    blocks = pack_blocks(p, "pid", ["pid", "ptext"], nb, out="p_items")
    chunks = pack_partitions(spread(d), ["did", "dtext"], out="d_items")
    pairs = pair_blocks(chunks, blocks, nb, total)
    return pairs.select("blk", "p_items", "d_items").mapInArrow(_matcher, "pid string, did string")
