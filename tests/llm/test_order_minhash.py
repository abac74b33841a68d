import hashlib
import random

import numpy as np
import pytest
from helpers_llm import clashing, documents, prose, table

from conversion_engine.llm import common, order_minhash as omh


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def slow_fingerprint(text, chosen=omh.CHOSEN, k=omh.K):
    """All k-mers ranked in every order."""
    if not text:
        return []
    letters = common.mixed(points(text).astype(np.uint64) * omh._ROUND + np.uint64(1))
    size = min(k, len(text))
    kmers = [int(x) for x in common.window_hashes(letters, size)]
    bits = max(1, (len(kmers) - 1).bit_length())
    seen, rows = {}, []
    for place, kmer in enumerate(kmers):
        number = seen[kmer >> bits] = seen.get(kmer >> bits, -1) + 1
        top = kmer >> bits << bits
        if number:
            top = int(common.mixed(np.array([(top + number * int(omh._ROUND)) % 2**64], np.uint64))[0]) >> bits << bits
        rows.append((top, place))
    out = []
    for order in omh._ORDERS:
        best = sorted(rows, key=lambda r: ((r[0] ^ int(order)) >> bits, r[1]))[:chosen]
        value = np.array([omh._PAD])
        for top, place in sorted(best, key=lambda r: r[1]):
            value = common.mixed(value * omh._ROUND + (np.array([top | place], np.uint64) >> np.uint64(max(bits, 32))))
        out.append(int(value[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("text", ["a", "short one", "ab " * 300, prose(1, 40), prose(2, 400), "é𝄞ü" * 50, "x" * 13, "y" * 500])
def test_selection_is_that_of_ranking_all_kmers(text):
    assert omh.fingerprint(points(text)).tolist() == slow_fingerprint(text)


def test_order_and_repeats_count():
    a, b = prose(3, 150), prose(4, 150)
    one, two = omh.fingerprint(points(f"{a} {b}")), omh.fingerprint(points(f"{b} {a}"))
    assert 0.2 < omh.likeness(one, two) < 0.8  # the same k-mers, but passages changed places
    assert omh.likeness(omh.fingerprint(points("ab " * 100)), omh.fingerprint(points("ab " * 200))) < 0.7
    assert omh.likeness(one, omh.fingerprint(points(f"{a} {b}"))) == 1.0


def test_likeness_falls_with_edits():
    rng, base = random.Random(5), prose(5, 500)
    last = 1.0
    for edits in (2, 20, 200):
        text = list(base)
        for at in rng.sample(range(len(text)), edits):
            text[at] = "#"
        now = omh.likeness(omh.fingerprint(points(base)), omh.fingerprint(points("".join(text))))
        assert now < last
        last = now


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        own, new, far = (omh.fingerprint(points(x)) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), omh.written(own), omh.written(new),
                  omh.likeness(own, new), omh.likeness(own, far))
    return out


@pytest.mark.parametrize("passes", [1, 4])
def test_against_plain_python(spark, passes):
    rows = [r for r in documents() if r[0] != 15] + [(30, prose(30, 60), None, None, 0)]
    got = omh.fingerprints(clashing(table(spark, rows)).repartition(6), passes).collect()
    want = expected([r[:2] for r in rows])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[r.doc_id], r.doc_id
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[2] and same[6] == same[7] == ""


def test_one_repeated_and_no_document(spark):
    out = omh.fingerprints(table(spark, [(4, "one text of its own, wrapped around", None, None, 0)])).collect()
    assert len(out) == 1 and out[0].near_next == 1.0 and out[0].edited_sha256 == hashlib.sha256(
        b"one text of its own, wrappe" + b"one text").hexdigest()
    again = omh.fingerprints(table(spark, [(1, "same words here", None, None, 0)] * 40)).collect()
    assert len(again) == 40 and len(set(again)) == 1
    assert omh.fingerprints(table(spark, [])).count() == 0
    assert omh.fingerprints(table(spark, [(None, None, None, None, None)])).collect()[0].near_next == 1.0
