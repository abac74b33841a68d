import itertools
import random
import zlib

import numpy as np
import pytest
from helpers_llm import clashing, documents, table

from conversion_engine.llm import packing
from conversion_engine.llm.queries import tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_give_the_tokenizers_ids():
    texts = [t or "" for _, t, *_ in documents()] + [
        "a  b", " a", "a ", "a \n b", "a\n\n b", "x  y", "a  b", "it's Don't  'll", "<|endoftext|> a", "\t\tx", "é è 漢字 😀"]
    tokens = packing.ChunkTokenizer(**tokenizer())
    got = [np.frombuffer(tokens(t), "<u4").tolist() + [0] for t in texts]
    assert got == reference_ids(texts)


def test_cuts_are_optimal():
    pick = random.Random(3)
    for _ in range(200):
        ends = list(itertools.accumulate(pick.randint(1, 6) for _ in range(9)))
        pen = [pick.choice([0, 2, 5]) for _ in ends]
        cost = lambda chosen: sum(
            pen[j] + 12 - (ends[j] - (ends[i] if i >= 0 else 0)) for i, j in zip([-1, *chosen], chosen))
        best = min(cost(c) for k in range(9) for rest in itertools.combinations(range(8), k) for c in [[*rest, 8]]
                   if all(ends[j] - (ends[i] if i >= 0 else 0) <= 12 for i, j in zip([-1, *c], c)))
        assert cost(packing.cuts(np.array(ends), np.array(pen), 12)) == best


def test_pieces_hold_every_id_once_in_order(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] != 15]
    df = clashing(table(spark, rows).coalesce(2))
    pieces = packing.pack(df, **tokenizer(), run_tokens=3000).collect()
    want = dict(zip([r[0] for r in rows], reference_ids([r[1] or "" for r in rows])))
    for doc, ids in want.items():
        mine = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist() == ids
        assert [p["start"] for p in mine] == [0, *itertools.accumulate(p["length"] for p in mine)][:-1]
        assert {p["doc_tokens"] for p in mine} == {len(ids)}
    total = 0
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), lambda p: p["sequence_id"]):
        group = list(group)
        assert [p["offset"] for p in group] == [0, *itertools.accumulate(p["length"] for p in group)][:-1]
        assert sum(p["length"] for p in group) <= 1024
        total += 1
    used = sum(map(len, want.values()))
    assert total <= used / 1024 * 1.03 + 2
    assert zlib.crc32(pieces[0]["ids"]) >= 0


def test_repeated_null_and_empty(spark):
    assert packing.pack(table(spark, []), **tokenizer()).count() == 0
    pieces = packing.pack(table(spark), **tokenizer())
    assert pieces.where("doc_id IS NULL").count() >= 1
    assert pieces.where("doc_id IN (6, 7) AND length = 1 AND doc_tokens = 1").count() == 2
    assert pieces.where("doc_id = 15 AND start = 0").count() == 2
