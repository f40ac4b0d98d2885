"""One JSON array read by many tasks.

A JSON array is one document, so a plain reader gives it to one task.  Here the text
is cut at its commas by the splittable text reader.  Whether a comma stands between
two elements of the array depends on all text before it, but only through two
things: whether a string is open, and how many brackets are.  So

1.  every split reports what it does to both, for either way it may begin
    (one row per split),
2.  the driver chains these rows, and every split learns how it begins and how many
    elements lie before it,
3.  every split cuts its text at the commas between elements.  Elements that reach
    over a border are put together from the pieces of their splits.

A backslash never stands before a comma in valid JSON, so no escape crosses a cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MARK = re.compile(r'\\.|["\[\]{}]', re.S)
_PIECES = "file string, number long, block long, text string"


class _Scan:
    """State of a scan: string open, bracket depth; top-level commas are counted per depth."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth = inside, depth

    def read(self, text: str) -> tuple[int, int]:
        """Advance over a piece without top-level decisions; returns (place behind an opening of the array, place of its end)."""
        begin, end = -1, -1
        for m in _MARK.finditer(text):
            c = m.group()
            if c == '"':
                self.inside = not self.inside
            elif not self.inside and c in "[{":
                self.depth += 1
                if self.depth == 1:
                    begin = m.end() if c == "[" else -2
            elif not self.inside and c in "]}":
                self.depth -= 1
                if self.depth == 0:
                    end = m.start()
        return begin, end


def _fragments(spark: SparkSession, path) -> DataFrame:
    """Text between commas, with its file and split; in file order within a split."""
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[str]]]:
    """((file, block), values) in order; a split may come in several parts."""
    for pdf in pdfs:
        for (file, block), rows in pdf.groupby(["file", "block"], sort=False):
            yield (file, int(block)), rows["value"].tolist()


def _summaries(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split and way to begin: way it ends, change of depth, commas outside strings by depth."""
    splits: dict[tuple, list] = {}
    for key, values in _by_split(pdfs):
        scans = splits.setdefault(key, [(_Scan(), Counter()), (_Scan(True), Counter())])
        for scan, commas in scans:
            for v in values:
                scan.read(v)
                if not scan.inside:
                    commas[scan.depth] += 1  # the comma behind the fragment
    for (file, block), scans in splits.items():
        for begins, (scan, commas) in enumerate(scans):
            yield pd.DataFrame({"file": [file], "block": [block], "begins": [bool(begins)], "ends": [scan.inside], "depth": [scan.depth],
                                "commas": [dict(commas)]})


def _starts(rows: list) -> dict[tuple, tuple[bool, int, int]]:
    """(file, block) -> (string open, depth, elements before) at its beginning."""
    found: dict[tuple, tuple[bool, int, int]] = {}
    by_file: dict[str, dict[int, dict]] = {}
    for r in rows:
        by_file.setdefault(r["file"], {}).setdefault(r["block"], {})[r["begins"]] = r
    for file, blocks in by_file.items():
        inside, depth, number = False, 0, 0
        for block in sorted(blocks):
            found[file, block] = (inside, depth, number)
            r = blocks[block][inside]
            number += r["commas"].get(1 - depth, 0)
            inside, depth = r["ends"], depth + r["depth"]
        # the comma counted behind the last fragment does not exist, so only the state is checked
        if inside or depth:
            raise ValueError(f"{file} ends inside a JSON value")
    return found


def _cutter(starts: dict):
    """Splits -> elements; the first and the last piece of a split may belong to elements that reach over its borders."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, list] = {}  # (file, block) -> [scan, element number, pieces]
        for key, values in _by_split(pdfs):
            if key not in open_:
                inside, depth, number = starts[key]
                open_[key] = [_Scan(inside, depth), number, []]
            state = open_[key]
            scan, out = state[0], []
            for v in values:
                closed = scan.depth == 0
                begin, end = scan.read(v)
                if begin == -2 or (closed and begin < 0 and v.strip()):
                    raise ValueError(f"{key[0]} is no JSON array")
                if end >= 0 and v[end + 1:].strip() or (begin > 0 and v[:begin - 1].strip("\ufeff \t\r\n")):
                    raise ValueError(f"{key[0]} has text outside its JSON array")
                state[2].append(v[max(begin, 0):end if end >= 0 else len(v)])
                if not scan.inside and scan.depth == 1:
                    out.append((state[1], ",".join(state[2])))
                    state[1:] = [state[1] + 1, []]
            if out:
                yield pd.DataFrame({"file": key[0], "number": [o[0] for o in out], "block": key[1], "text": [o[1] for o in out]})
        for (file, block), (_, number, pieces) in open_.items():
            if pieces:
                yield pd.DataFrame({"file": [file], "number": [number], "block": [block], "text": [",".join(pieces)]})

    return run


def read_json_array(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """Elements of the JSON arrays in ``path`` as columns of ``schema``, with their position ``_pos`` (file, number).

    Every file is one array of objects; malformed text fails the job.  A file of
    several splits (``spark.sql.files.maxPartitionBytes``) is read by several tasks.
    """
    fragments = _fragments(spark, path)
    told = "file string, block long, begins boolean, ends boolean, depth int, commas map<int,long>"
    starts = _starts(fragments.mapInPandas(_summaries, told).collect())  # two rows per split
    pieces = fragments.mapInPandas(_cutter(starts), _PIECES)
    # pieces of one element lie in neighbouring splits; most elements are one piece
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    whole = pieces.groupBy("file", "number").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), ",").alias("text"))
    whole = whole.where(F.trim(F.regexp_replace("text", r"[\t\r\n]", " ")) != "")  # the empty array
    parsed = whole.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("o"), F.struct("file", "number").alias("_pos"))
    return parsed.select("o.*", "_pos")
