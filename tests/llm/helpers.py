"""Small fixtures of the training-data tests."""

import zlib

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOC_SCHEMA):
    """Rows of (doc_id, text[, lang[, source]]); n_chars follows the text."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, schema)


def by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def components(n, links):
    """Smallest member of each of n nodes' components."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]
