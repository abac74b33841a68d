from collections import Counter

import numpy as np
import pytest
from helpers_llm import as_dict, clashing, documents, prose, table, words

from conversion_engine.llm import common, substrings


def brute_force(rows, window):
    texts = {i: words(t) for i, t, *_ in rows}
    seen = Counter(tuple(w[k:k + window]) for w in texts.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in texts.items():
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for p in range(k, k + window)}
        out[i] = (" ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone))
    return out


@pytest.mark.parametrize("window", [35, 7])
def test_against_brute_force(spark, window):
    rows = [r for r in documents() if r[0] != 15]
    got = as_dict(substrings.dedup_substrings(clashing(table(spark, rows)), window))
    assert got == brute_force(rows, window)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, prose(1, 50), None, None, 0)] * 2
    assert {r["n_removed"] for r in substrings.dedup_substrings(table(spark, rows)).collect()} == {0}
    assert substrings.dedup_substrings(table(spark, [])).count() == 0


def test_window_hashes_are_polynomials():
    h = np.random.default_rng(0).integers(0, 1 << 63, 60).astype(np.uint64)
    for length in (1, 2, 3, 9, 18, 35):
        base, want = 0x9E3779B97F4A7C15, []
        for i in range(60 - length + 1):
            x = 0
            for j in range(length):
                x = (x * base + int(h[i + j])) % (1 << 64)
            want.append(x)
        assert (common.window_hashes(h, length) == common.mixed(np.array(want, np.uint64))).all()
    assert len(common.window_hashes(h[:5], 9)) == 0
    assert substrings.levels(35) == [9, 18, 35]


def test_words_have_their_own_hashes():
    texts = [b"", b" a\tb  A ", "\u00e9 \u00e9".encode(), b"a" * 5000 + b" x", b"ba ab", b"\n", b"a b A"]
    hashes, bounds = common.hashed_words(texts)
    split = [t.split() for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in split]
    names = [w for s in split for w in s]
    assert all((names[i] == names[j]) == (hashes[i] == hashes[j]) for i in range(len(names)) for j in range(i))
    folded, _ = common.hashed_words(texts, fold=True)
    assert folded[0] == hashes[0] == folded[2] != hashes[2]
    assert [len(x) for x in (common.hashed_words([b""])[0], common.hashed_words([])[0])] == [0, 0]
