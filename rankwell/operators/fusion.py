"""Late fusion of two modality embeddings and user pair scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import vector_add
from .embed import factory_key


def fuse(a: DataFrame, b: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Element-wise sum of two vectors per id.

    Both sides must hold the same ids and vectors of equal length; an id of one
    side only, or unequal lengths, fail the job.
    """
    right = b.select(F.col(id_col).alias("_id"), F.col(vec).alias("_b"))
    j = a.select(id_col, F.col(vec).alias("_a")).join(right, F.col(id_col) == F.col("_id"), "full_outer")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    checked = F.when(lone, F.raise_error(F.concat(F.lit("id on one side only: "), F.coalesce(F.col(id_col), F.col("_id")).cast("string"))))
    checked = checked.when(F.size("_a") != F.size("_b"), F.raise_error(F.lit("fused vectors differ in length")))
    return j.select(F.coalesce(F.col(id_col), F.col("_id")).alias(id_col), F.coalesce(checked.cast("array<double>"), vector_add("_a", "_b")).alias(vec))


PairScorerFactory = Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]]
_SCORERS: dict[str, Callable] = {}


def score_with(pairs: DataFrame, factory: PairScorerFactory, q_text: str = "q_text", d_text: str = "d_text",
               out: str = "score") -> DataFrame:
    """Score joined (query text, document text) rows with a user scorer
    (e.g. a cross-encoder) in Arrow batches; the scorer is built once per worker."""
    keep = [c for c in pairs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + f", `{out}` double"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = factory_key(factory)
        if key not in _SCORERS:
            _SCORERS[key] = factory()
        scorer = _SCORERS[key]
        for pdf in pdfs:
            s = np.asarray(scorer(pdf[q_text], pdf[d_text]), dtype=np.float64)
            res = pdf[keep].copy()
            res[out] = np.where(np.isnan(s), -1.0, s)
            yield res

    return pairs.mapInPandas(run, schema)


def token_overlap(q_text: str = "q_text", d_text: str = "d_text"):
    """Jaccard overlap of lower-cased token sets as a column (0 if both are empty)."""
    a, b = (F.array_distinct(tokens(F.coalesce(F.col(c), F.lit("")))) for c in (q_text, d_text))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_scorer() -> Callable[[pd.Series, pd.Series], np.ndarray]:
    """Example of a user pair scorer: Jaccard overlap of lower-cased token sets.

    Every distinct text of a batch is split once.
    """
    import re

    def score(qs: pd.Series, ds: pd.Series) -> np.ndarray:
        sets = {t: {x for x in re.split("[ \n]+", (t or "").lower()) if x} for t in pd.unique(pd.concat([qs, ds], ignore_index=True))}
        both = [(sets[q], sets[d]) for q, d in zip(qs, ds)]
        inter = np.array([len(a & b) for a, b in both], dtype=np.float64)
        union = np.array([len(a) + len(b) for a, b in both], dtype=np.float64) - inter
        return np.divide(inter, union, out=np.zeros(len(both)), where=union > 0)

    return score
