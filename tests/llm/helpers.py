"""Plain versions of what the operators do in parts."""

import re

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, texts, **extra):
    """A documents table from texts, or (doc_id, text) or (doc_id, text, source) tuples."""
    rows = []
    for i, t in enumerate(texts):
        doc = t if isinstance(t, tuple) else (i, t)
        source = doc[2] if len(doc) > 2 else "s"
        rows.append((doc[0], doc[1], "en", source, len(doc[1] or "")))
    df = spark.createDataFrame(rows, DOC)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


def load(spark, name="documents"):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")
