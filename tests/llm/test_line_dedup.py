from helpers_llm import as_dict, clashing, documents, table

from conversion_engine.llm import line_dedup


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1:] == b[p + 1:] or a[p:] == b[p + 1:] or a[p + 1:] == b[p:]


def brute_force(rows, least=9):
    unique = sorted({(i, t) for i, t, *_ in rows if t is not None and i is not None})
    lines = [(i, n, line, line.lower().split()) for i, t in unique for n, line in enumerate(t.split("\n"))]
    first = {}
    for i, n, _, w in lines:
        if w:
            first.setdefault(tuple(w), (i, n))
    out = {i: ([], 0, 0) for i, _ in unique}
    for i, n, line, w in lines:
        kept, exact, near = out[i]
        if w and first[tuple(w)] != (i, n):
            out[i] = kept, exact + 1, near
        elif len(w) >= least and any(len(o) >= least and o != tuple(w) and at < (i, n) and distance_at_most_one(list(o), w)
                                     for o, at in first.items()):
            out[i] = kept, exact, near + 1
        else:
            out[i] = [*kept, line], exact, near
    return {i: ("\n".join(k), e, n) for i, (k, e, n) in out.items()}


def test_against_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    got = as_dict(line_dedup.dedup_lines(clashing(table(spark, rows))).select("doc_id", "text", "_n_lines", "n_exact", "n_near"))
    want = brute_force(rows)
    for doc, (text, exact, near) in want.items():
        assert got[doc][0] == text and got[doc][2:] == (exact, near), doc
    assert got[7][0] is None and got[7][1:] == (0, 0, 0)
    assert got[19][3] >= 2  # replaced, and shortened by a word


def test_templates_keep_the_earliest(spark):
    rows = [(i, f"user {i} logged in from the same old place again today", None, None, 0) for i in range(300)]
    out = line_dedup.dedup_lines(table(spark, rows))
    assert out.where("n_near = 0").select("doc_id").collect()[0][0] == 0
    assert out.where("n_near = 1").count() == 299


def test_null_ids_and_empty_table(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    rows = [(None, "same line", None, None, 0), (1, "same line", None, None, 0), (1, "other", None, None, 0)]
    out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert out == {(None, "same line"), (1, ""), (1, "other")}
