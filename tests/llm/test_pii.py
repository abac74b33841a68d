import re

import pytest
from helpers_llm import clashing, table

from conversion_engine.llm import pii


def by_regex(text):
    """The base rules, as plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        double = [(2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(double) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_plain_spans_are_those_of_the_rules():
    import random

    pick = random.Random(1)
    parts = ["@", ".", "a", "b1", " ", "-", "+", "4111 1111 1111 1111", "10.0.0.255", "300.1.2.3", "+1 (555) 010-9999", "1.2.3.4.5.6.7.8",
             "x@y.z", "@@", "a@b", "é", "0", "99", "%", "378282246310005", "\n", "(", ")"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert [(s, k, e) for s, k, e, _ in pii.find(text)] == by_regex(text), text


@pytest.mark.parametrize("text, kind, span, value", [
    ("write john [at] example [dot] com please", "email", "john [at] example [dot] com", "john@example.com"),
    ("john at example dot com", "email", "john at example dot com", "john@example.com"),
    ("mail: jоhn@example.com!", "email", "jоhn@example.com", "john@example.com"),
    ("jo​hn@ex.com", "email", "jo​hn@ex.com", "john@ex.com"),
    ("user(at)site(dot)org", "email", "user(at)site(dot)org", "user@site.org"),
    ("call plus four four two zero seven nine four six zero nine five eight now", "phone",
     "plus four four two zero seven nine four six zero nine five eight", "+442079460958"),
    ("ip one two seven dot zero dot zero dot one ok", "ip", "one two seven dot zero dot zero dot one", "127.0.0.1"),
    ("card 4O12 8888 8888 1881.", "card", "4O12 8888 8888 1881", "4012 8888 8888 1881"),
    ("１０.0.0.1", "ip", "１０.0.0.1", "10.0.0.1"),
])
def test_disguises_map_back(text, kind, span, value):
    found = [(k, text[s:e], v) for s, k, e, v in pii.disguised(text, pii.find(text))]
    assert (kind, span, value) in found


@pytest.mark.parametrize("text, kind, span, value", [
    ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10", "192.168.1.10"),
    ("host 192 dot 168 dot one dot zero", "ip", "192 dot 168 dot one dot zero", "192.168.1.0"),
    ("number two 192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10", "192.168.1.10"),
    ("in 2024 192 dot 168 dot one dot zero", "ip", "192 dot 168 dot one dot zero", "192.168.1.0"),
    ("call plus four four 2079460958", "phone", "plus four four 2079460958", "+44 2079460958"),
    ("call plus 442079460958 now", "phone", "plus 442079460958", "+442079460958"),
    ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one", "4111 1111 1111 111 1"),
    ("info at one dot com", "email", "info at one dot com", "info@one.com"),
    *[(f"john at example dot {top}", "email", f"john at example dot {top}", f"john@example.{top}")
      for top in ("nl", "ru", "mx", "ca", "be", "museum")],
])
def test_one_word_in_a_run_is_enough(text, kind, span, value):
    found = [(k, text[s:e], v) for s, k, e, v in pii.disguised(text, pii.find(text))]
    assert found == [(kind, span, value)]


def test_a_span_without_a_rewrite_is_not_disguised():
    for text in ("we met at the dot and left", "3 point 5 and 10.0.0.1", "one, two and plus 10, +44 20 7946 0958"):
        assert pii.disguised(text, pii.find(text)) == []


@pytest.mark.parametrize("text", ["meet at the dot of night", "one two three", "at dot com", "he is 6 at seven", "look at example.com",
                                  "two dogs, four cats, one bird and three fish", "Москва 2024"])
def test_ordinary_texts_gain_nothing(text):
    assert pii.disguised(text, pii.find(text)) == []


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "a" * 100_000 + "@", "1" * 100_000, "+1" * 50_000, "a@" * 50_000, "1." * 50_000):
        pii.find(text)
    # More digits than int() takes: leading zeros don't count, other long parts are above 255.
    assert pii.find("x 1.1.1." + "0" * 6000 + "2") == [(2, "ip", 6009, "1.1.1." + "0" * 6000 + "2")]
    assert pii.find("x 1.1.1." + "0" * 6000) == [(2, "ip", 6008, "1.1.1." + "0" * 6000)]
    assert pii.find("x 1.1.1." + "3" * 6000) == []


def test_table(spark):
    rows = [(1, "a@b.co and a@b.co", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, "1.2.3.4", None, None, 0),
            (1, "a@b.co and a@b.co", None, None, 0), (4, "x [at] y [dot] de", None, None, 0)]
    out = pii.detect(clashing(table(spark, rows))).select("doc_id", "spans", pii.written("spans").alias("t")).collect()
    assert sorted((r["doc_id"] or 0, r["t"]) for r in out) == [
        (0, "ip:0:7"), (1, "email:0:6,email:11:17"), (1, "email:0:6,email:11:17"), (2, ""), (3, ""), (4, "email:0:17")]
    assert [s["plain"] for r in out if r["doc_id"] == 4 for s in r["spans"]] == [False]
    assert pii.detect(table(spark, [])).count() == 0
    assert pii.masked("a x@y.z b", [(2, 7, "email")]) == "a <email> b"
