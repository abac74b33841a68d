import numpy as np
import pytest
from helpers_llm import as_dict, clashing, documents, table, words

from conversion_engine.llm import ngram_join as nj


def brute_force(rows, n, percent):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"group": 2, "block_bytes": 3000}])
def test_against_brute_force(spark, limits):
    rows = [r for r in documents() if r[0] is not None]
    got = as_dict(nj.jaccard_components(clashing(table(spark, rows)), **limits).drop("representative"))
    assert got == brute_force(rows, 4, 85)


def test_one_of_each(spark):
    kept = nj.one_of_each(table(spark))
    rows = [r for r in documents() if r[0] is not None]
    want = {i for i, (_, group) in brute_force(rows, 5, 80).items() if group == i}
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == table(spark).columns


def test_empty_table_and_nulls(spark):
    assert nj.jaccard_components(table(spark, [])).count() == 0
    rows = [(None, "a b c d e", None, None, 0), (None, "a b c d e", None, None, 0), (3, "A b c d e", None, None, 0), (None, None, None, None, 0)]
    got = sorted(map(str, nj.jaccard_components(table(spark, rows)).select("n_shingles", "component_id").collect()))
    assert got == ["Row(n_shingles=0, component_id=None)"] + ["Row(n_shingles=2, component_id=3)"] * 3


def test_trie_finds_all_pairs_and_bitmaps_lose_none():
    random = np.random.default_rng(1)
    for _ in range(120):
        base = [random.choice(400, random.integers(3, 80), replace=False) for _ in range(4)]
        sets = []
        for _ in range(random.integers(2, 25)):
            b = base[random.integers(4)]
            kept = np.unique(np.concatenate([b[random.random(len(b)) > random.random() * 0.2], random.choice(400, random.integers(1, 4))]))
            kept = kept.astype(np.uint64)
            sets.append(np.concatenate([kept[kept % 3 != 0], kept[kept % 3 == 0]]))
        pairs = {(j, i) for i in range(len(sets)) for j in range(i)
                 if nj.similar(len(set(sets[i].tolist()) & set(sets[j].tolist())), len(sets[i]), len(sets[j]), 70)}
        trie = nj.Trie(sets)
        found = {(min(i, j), max(i, j)) for i in range(len(sets)) for node, overlap in trie.overlaps(np.sort(sets[i]), 70)
                 for j in trie.leaf_of[node] if j != i and nj.similar(overlap, len(sets[i]), len(sets[j]), 70)}
        assert found == pairs

        def groups(links):
            label = list(range(len(sets)))
            for a, b in links:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        assert groups(nj.links(sets, 70)) == groups(pairs)
        close = groups(nj.close(np.array(list(map(len, sets))), [nj.bitmap(s, nj.width(len(s))) for s in sets], 70))
        assert all(close[a] == close[b] for a, b in pairs)
