"""Text column expressions (JVM-side built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hashed bag-of-words embedder: tokens are the lower-cased
# text split on runs of spaces and newlines (empties dropped); a token's bucket
# is the integer value of the first 8 hex digits of its md5, modulo the width.
TOKEN_SPLIT = "[ \n]+"
HASH_HEX_DIGITS = 8


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compose_text(title: Column | str, text: Column | str) -> Column:
    """``(title or "") + " " + (text or "")`` - the separator always stays."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(text), F.lit("")))


def tokens(text: Column | str) -> Column:
    """Lower-cased whitespace tokens without empties."""
    return F.array_remove(F.split(F.lower(_c(text)), TOKEN_SPLIT), "")


def token_bucket(token: Column, dim: int) -> Column:
    """md5 bucket of one token: ``int(md5(tok)[:8], 16) % dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint"), F.lit(dim))


def token_buckets(text: Column | str, dim: int) -> Column:
    """Array of md5 buckets, one per token (input of the bag-of-words counts)."""
    return F.transform(tokens(text), lambda t: token_bucket(t, dim).cast("int"))


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()`` for the characters qrels files carry (space, tab, CR, LF)."""
    return F.regexp_replace(_c(c), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def sequence_text(items: Column | str) -> Column:
    """Concatenate the text parts of a sequence, each followed by one space."""
    return F.aggregate(
        F.filter(_c(items), lambda i: i["text"].isNotNull()),
        F.lit(""),
        lambda acc, i: F.concat(acc, i["text"], F.lit(" ")),
    )


def sequence_first_image(items: Column | str) -> Column:
    """The first image reference of a sequence (null when none)."""
    return F.get(F.filter(_c(items), lambda i: i["path"].isNotNull()), 0)


def default_package(package: Column | str, default: str) -> Column:
    """``package or default`` (empty string counts as missing)."""
    return F.coalesce(F.nullif(_c(package), F.lit("")), F.lit(default))
