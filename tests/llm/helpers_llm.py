"""A small table of documents with the awkward cases, and plain-Python words."""

import random
import re

WORDS = "the of and river stone light walks under seven old green houses while nobody counts the falling rain".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars) rows: copies, near copies, shared passages, NULLs, empties, a long text."""
    base = prose(1, 200)
    shared = prose(2, 60)
    near = base.split()
    near[20] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(3, 90) + "\n" + shared), (5, shared + "\n" + prose(4, 80)),
            (6, ""), (7, None), (8, " \t \n"), (9, "one two"), (10, "one two"), (11, "ONE two"), (12, "one"),
            (13, prose(5, 20_000)), (14, "ab " * 400), (None, prose(6, 70)), (15, prose(7, 70)), (15, prose(7, 70)),
            (16, prose(8, 35)), (17, prose(8, 36)), (18, "\n\n".join([prose(9, 12)] * 4)),
            (19, "line a b c d e f g h i\nline a b c d e x g h i\nline a b c d e f g h\n\nunique " + prose(10, 9))]
    rows += [(100 + i, f"head {i} " + base) for i in range(5)]
    return [(i, t, None if i == 12 else "en", None if (i or 0) % 7 == 3 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df):
    """The table with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("_k", "_k1", "_id", "_text", "n_lines", "rank", "slot", "score", "component_id", "kept", "n_words", "_h",
             "_line", "rejected", "host", "_src", "_o1", "_kept", "_rank", "_c", "c0", "_first")
    return df.withColumns({n: F.lit("clash") for n in names})


def as_dict(df, key="doc_id"):
    """Rows by key; equal rows of a key are one."""
    out = {}
    for row in df.collect():
        value = tuple(v for k, v in row.asDict().items() if k != key)
        assert out.setdefault(row[key], value) == value, row
    return out
