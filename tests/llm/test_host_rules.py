import re

import pytest
from helpers_llm import clashing, documents, prose, table, words

from conversion_engine.llm import host_rules


def counts(text):
    text = text or ""
    w = words(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    where = {}
    for k, g in enumerate(grams):
        where.setdefault(g, []).append(k)
    covered = {p for at in where.values() if len(at) > 1 for k in at for p in range(k, k + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_counts_against_brute_force(spark):
    rows = documents() + [(30, "a b c a b c a b\nx\n x\nx", None, "h", 0), (31, "é# |é\n \n ", None, "h", 0), (32, "a a a a", None, None, 0)]
    got = sorted(map(tuple, host_rules.metrics(clashing(table(spark, rows)), keep=("doc_id",)).collect()), key=str)
    assert got == sorted([(i, *counts(t)) for i, t, *_ in rows], key=str)


def test_hosts(spark):
    rows = [(i, prose(i, 80), None, "good" if i % 2 else None, 0) for i in range(40)]
    rows += [(100 + i, "short " * 3 if i < 38 else prose(i, 80), None, "bad", 0) for i in range(40)]
    rows += [(200, "short", None, "tiny", 0), (201, None, None, "good", 0), (202, "", None, None, 0)]
    rows += [(1000 + i, prose(5000 + i, 60), None, f"h{i % 30}", 0) for i in range(300)]
    out = {r["doc_id"]: r for r in host_rules.judge(table(spark, rows)).collect()}
    assert not out[138]["base_failed"] and not out[138]["kept"]  # its host fails
    assert out[1]["kept"] and out[0]["kept"] and out[1005]["kept"]
    assert not out[201]["kept"] and not out[202]["kept"] and out[201]["n_words"] == 0
    df = table(spark, rows).selectExpr("source", "length(coalesce(text, '')) < 100 AS f")
    v = {r["host"]: r for r in host_rules.host_verdicts(df, "source", "f").collect()}
    n = sum(r["n_documents"] for r in v.values())
    m = sum(r["n_failed"] for r in v.values()) / n
    extra = sum(r["n_failed"] ** 2 / r["n_documents"] for r in v.values()) / n - m * m - m * (1 - m) * len(v) / n
    strength = max(1.0, min(n, m * (1 - m) / extra - 1))
    for r in v.values():
        assert r["shrunk_rate"] == pytest.approx((r["n_failed"] + m * strength) / (r["n_documents"] + strength))
    assert v["tiny"]["shrunk_rate"] < 1 and None not in v


def test_empty_repeated_and_clashing(spark):
    assert host_rules.judge(table(spark, [])).count() == 0
    rows = [(1, prose(1, 60), None, "a", 0)] * 3
    assert host_rules.judge(clashing(table(spark, rows))).where("kept").count() == 3
