"""Tables with the awkward cases that every operator must take."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=None):
    """A ``documents`` table of the given texts (ids by place), or of (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def awkward(words):
    """Null, empty, blank, long, repeated and tied texts made of ``words``."""
    line = " ".join(words)
    return [None, "", "   \n\t ", line, line, line.upper(), (line + "\n") * 60, words[0], "\n".join(words * 2), "\n\n\n"]
