import random
import re
import zlib
from collections import Counter

import pytest
from helpers_llm import clashing, documents, table

from conversion_engine.llm import common, spelling

ROOT = "/root/testdata/sf0.001"


def counted(rows, least=7, times=2):
    words = Counter()
    for doc, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in raw)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= times}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def grouped(counts, near, ratio=10):
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w
    return {w: (forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items()}


def brute_force(counts, ratio=10):
    return grouped(counts, {w: [v for v in counts if one_apart(w, v)] for w in counts}, ratio)


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def random_counts(seed, letters, least, most, size):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(size)}
    for w in sorted(words)[:size // 2]:
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        words.add(w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind != 2):])
    return {w: int(10 ** rng.uniform(0, 4)) + 1 for w in sorted(words - {""})}


@pytest.mark.parametrize("letters, least, most, size", [("ab", 1, 9, 220), ("abcdefé𝄞", 3, 7, 400), ("xyzÀÿß", 7, 30, 300)])
def test_random_words_against_all_pairs(spark, letters, least, most, size):
    counts = random_counts(size, letters, least, most, size)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert result(spelling.group_variants(df)) == brute_force(counts)


def test_chains_prefixes_runs_and_long_words(spark):
    counts = {"a" * n: 2 for n in range(1, 30)}  # every word the beginning of the next
    counts |= {"colour": 10_000, "color": 1000, "colr": 100, "coler": 100, "colours": 5, "x": 3, "aab": 2, "aba": 2, "baa": 2}
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    counts |= {long: 50, long[:9_000] + long[9_001:]: 3, long[:5] + "z" + long[6:]: 4, long + "q": 2}
    df = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long")
    got = result(spelling.group_variants(df))
    assert got == brute_force(counts)
    assert got["colr"][:2] == ("color", "colour") and got["coler"][1] == "colour"


def test_ties_ratio_and_empty(spark):
    df = lambda rows: spark.createDataFrame(rows, "word string, n long, _w string, form string")
    got = result(spelling.group_variants(df([(w, n, "clash", "") for w, n in (("bat", 20), ("cat", 20), ("hat", 2), ("mat", 3))])))
    assert got["hat"] == ("bat", "bat", 2, 3, 20) and got["mat"] == (None, "mat", 3, 3, None)
    assert spelling.group_variants(df([])).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(df([]), ratio=1)


def test_words_and_misspellings(spark):
    rows = [(i, f"Straße ÉCOLE naïve-looking don't x×y÷z {'Wörterbuch' * 3} 𝄞music{i} Ā ā") for i in range(200)] + [(None, "None here"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 5):
        got = {r.word: r.n for r in spelling.word_counts(df, least).collect()}
        want = {w: n for w, n in counted(rows, least, 1).items() if w}
        assert got == want


def test_documents_against_all_pairs(spark):
    rows = documents()
    assert result(spelling.spelling_variants(clashing(table(spark, rows)), least=3)) == brute_force(counted([r[:2] for r in rows], 3))


def test_hot_words(spark):
    """A third of all words begin alike; no node's words are joined with each other."""
    words = {f"commonstem{i:04d}".translate(str.maketrans("0123456789", "abcdefghij")): 2 for i in range(1500)}
    shelf = common.Shelf(spark, "spelling-test")
    df = shelf.put(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "_w long, word string"), "words")
    stops, edges = spelling.trie(df, shelf)
    assert stops.join(edges, "_node").count() < 1500 * 2 * 14 * 12
    got = result(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    letters = {w: {w[:p] + c + w[p + 1:] for p in range(10, 14) for c in "abcdefghij"} - {w} for w in words}
    assert {w: r[3] for w, r in got.items()} == {w: len(letters[w] & set(words)) for w in words}


def test_whole_table_against_neighbourhoods(spark):
    """The given texts, all words, against generated neighbours."""
    import pathlib

    if not pathlib.Path(ROOT).exists():
        pytest.skip("test data is not here")
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    counts = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    alphabet = sorted({c for w in counts for c in w})

    def neighbours(w):
        out = {w[:p] + c + w[p + 1:] for p in range(len(w)) for c in ["", *alphabet]}
        out |= {w[:p] + c + w[p:] for p in range(len(w) + 1) for c in alphabet}
        return [v for v in out - {w} if v in counts]
    assert result(spelling.spelling_variants(docs)) == grouped(counts, {w: neighbours(w) for w in counts})
