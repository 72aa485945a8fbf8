from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    """A documents table; entries are texts or (doc_id, text)."""
    rows = [(t if isinstance(t, tuple) else (start + i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}


def vocabulary(n, stem="w"):
    return [f"{stem}{i}" for i in range(n)]


def classes(n, links):
    """The smallest member of each node's class, from links between numbers below n."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
