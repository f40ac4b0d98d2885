"""Embedding of text tables.

``embed`` runs a user embedder over slices of Arrow batches with ``mapInArrow``: rows
are sorted by text inside each partition first (similar lengths batch
together), the embedder is built once per Python worker, ids travel with their
vectors so no order has to be restored.  Mixed-modality tables are embedded
per modality and concatenated (TEXT, IMAGE, SEQ).

``hashed_embedding`` is the deterministic bag-of-words embedder used by the
tests and the derived task families: md5 buckets are computed JVM-side, only
the per-row bucket count (``numpy.bincount``) runs in a pandas UDF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import HASH_HEX_DIGITS, TOKEN_SPLIT, token_buckets
from .blocks import spread

MODALITY_ORDER = ("TEXT", "IMAGE", "SEQ")

# Tokens that are counted at once; bytes of input that an embedder gets at once, whatever the size of an Arrow batch.
COUNT_TOKENS, EMBED_BYTES = 1 << 20, 8 << 20

# An embedder factory returns a callable: pandas DataFrame of inputs -> 2-D array.
EmbedderFactory = Callable[[], Callable[[pd.DataFrame], np.ndarray]]

_WORKER_MODELS: dict[str, Callable] = {}


def factory_key(factory) -> str:
    """Stable identity of a factory across tasks (each task unpickles a new object)."""
    import hashlib

    from pyspark import cloudpickle

    return hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()


def _model(factory: EmbedderFactory):
    key = factory_key(factory)
    if key not in _WORKER_MODELS:
        _WORKER_MODELS[key] = factory()
    return _WORKER_MODELS[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches as pandas tables of about ``EMBED_BYTES``, so that a whole batch never becomes Python objects at once."""
    for batch in batches:
        step = max(1, int(batch.num_rows * EMBED_BYTES // max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, step):
            yield pa.Table.from_batches([batch.slice(lo, step)]).to_pandas()


def embed(
    df: DataFrame,
    factory: EmbedderFactory,
    id_col: str = "id",
    input_cols: tuple[str, ...] = ("data",),
    sort_col: str | None = "data",
    out: str = "vec",
) -> DataFrame:
    """V6: ``(id, inputs...)`` -> ``(id, vec array<double>)`` with a user embedder; a null id fails the job."""
    # a text before the batches: pandas would turn integer ids beside a null into floats
    text = F.col(id_col).cast("string")
    ident = F.when(text.isNull(), F.raise_error(F.lit(f"missing required field {id_col}"))).otherwise(text)
    src = df.select(ident.alias(id_col), *[c for c in input_cols if c != id_col])
    if sort_col:
        src = src.sortWithinPartitions(sort_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory)
        for pdf in _slices(batches):
            vecs = np.asarray(model(pdf[list(input_cols)]), dtype=np.float64)
            if vecs.shape[0] != len(pdf):
                raise ValueError("embedder returned a different number of vectors than inputs")
            flat = pa.array(vecs.reshape(-1))
            offsets = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(pdf[id_col], pa.string()), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, out])

    return src.mapInArrow(run, f"`{id_col}` string, `{out}` array<double>")


def embed_mixed(df: DataFrame, factories: dict[str, EmbedderFactory], id_col: str = "id",
                input_cols: tuple[str, ...] = ("data",), modal_col: str = "modal") -> DataFrame:
    """Embed each modality with its own embedder, then concatenate."""
    parts = []
    for m in MODALITY_ORDER:
        if m in factories:
            sub = df.where(F.col(modal_col) == F.lit(m))
            parts.append(embed(sub, factories[m], id_col, input_cols, sort_col=input_cols[0]))
    if not parts:
        raise ValueError("no embedder for any modality")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts(buckets: list, dim: int) -> np.ndarray:
    """Counts per bucket of every row: one ``bincount`` over ``row * dim + bucket`` for some rows at a time, of about ``COUNT_TOKENS`` tokens."""
    sizes = np.array([0 if b is None else len(b) for b in buckets], dtype=np.int64)
    share = (np.cumsum(sizes) - sizes) // COUNT_TOKENS
    ends = np.flatnonzero(np.concatenate([share[1:] != share[:-1], [True]])) + 1
    out, lo = np.zeros((len(buckets), dim)), 0
    for hi in ends:
        rows = [b for b in buckets[lo:hi] if b is not None and len(b)]
        if rows:
            flat = np.concatenate(rows).astype(np.int64, copy=False) + np.repeat(np.arange(hi - lo) * dim, sizes[lo:hi])
            out[lo:hi] = np.bincount(flat, minlength=(hi - lo) * dim).reshape(hi - lo, dim)
        lo = hi
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _bincount(buckets: pd.Series, dims: pd.Series) -> pd.Series:
    """Bag-of-words vectors of a batch."""
    if not len(buckets):
        return pd.Series([], dtype=object)
    return pd.Series(list(_counts(list(buckets), int(dims.iloc[0]))))


def hashed_embedding(df: DataFrame, text_col: str = "text", dim: int = 64, out: str = "vec") -> DataFrame:
    """Bag-of-words vector: count of tokens per md5 bucket (see ``functions.text``)."""
    return spread(df).withColumn(out, _bincount(token_buckets(text_col, dim), F.lit(dim)))


class HashedBagOfWords:
    """The same embedder in plain Python, usable as a user embedder with ``embed``."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, inputs: pd.DataFrame) -> np.ndarray:
        import re

        col = inputs.iloc[:, 0]
        out = np.zeros((len(col), self.dim))
        for i, text in enumerate(col):
            for tok in re.split(TOKEN_SPLIT, (text or "").lower()):
                if tok:
                    h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:HASH_HEX_DIGITS], 16)
                    out[i, h % self.dim] += 1.0
        return out
