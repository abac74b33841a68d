import itertools
import random

import numpy as np
import pytest
from helpers_llm import WORDS, clashing, prose, table

from conversion_engine.llm import labels, quality_crf, toxicity


def test_forward_backward_is_exact():
    random_ = np.random.default_rng(3)
    per_text = np.array([3, 1, 4])
    emission, change = random_.normal(size=8) * 3, random_.normal(size=(2, 2))
    good, pairs, log_z = quality_crf.forward_backward(emission, change, *quality_crf.chains(per_text))
    want, want_pairs, total = [], np.zeros((2, 2)), 0.0
    for start, n in zip([0, 3, 4], per_text):
        weight, marginal, count = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=int(n)):
            p = np.exp(sum(emission[start + k] * y[k] for k in range(n)) + sum(change[a, b] for a, b in zip(y, y[1:])))
            weight += p
            marginal += p * np.array(y)
            for a, b in zip(y, y[1:]):
                count[a, b] += p
        want += (marginal / weight).tolist()
        want_pairs += count / weight
        total += np.log(weight)
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_fit_is_at_a_stationary_point_and_separates():
    random_ = np.random.default_rng(0)
    per_text = random_.integers(1, 6, 200)
    good = random_.random(200) < 0.7
    x = np.column_stack([np.repeat(good, per_text) * 1.0 + random_.normal(size=per_text.sum()), np.ones(per_text.sum())])
    model = quality_crf.fit(x, per_text, good)
    p = model.good(x, per_text)
    assert ((p > 0.5) == np.repeat(good, per_text)).mean() > 0.85


def corpus():
    pick = random.Random(4)
    rows, marks = [], []
    for i in range(240):
        text = "\n".join(prose(1000 * i + k, 25) for k in range(3))
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            text = " ".join(w + pick.choice(["&&&", "###", "%%%"]) for w in text.split())
        if toxic:
            w = text.split(" ")
            for _ in range(4):
                w.insert(pick.randrange(len(w)), pick.choice(["idiot", "you moron", "zorgling", "zorgler"]))
            text = " ".join(w)
        rows.append((i, text, "en", "s", 0))
        marks.append((i, int(not bad), int(toxic)))
    extra = [(1000, "", None, None, 0), (1001, None, None, None, 0), (None, prose(1, 30), None, None, 0), (1002, prose(2, 20_000), None, None, 0),
             (3, rows[3][1], "en", "s", 0)]
    return rows + extra, marks + [(1000, None, None), (None, 1, 1), (5000, 1, 0)]


@pytest.fixture(scope="module")
def labelled(spark):
    rows, marks = corpus()
    return clashing(table(spark, rows)).cache(), spark.createDataFrame(marks, "doc_id long, quality int, toxic int").cache()


def test_training_never_sees_the_held_out_fold(spark, labelled):
    import zlib

    docs, marks = labelled
    ids = [r["_id"] for r in labels.training_sample(docs, marks, "quality", 10_000).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and 1000 not in ids
    assert len({r["_id"] for r in labels.training_sample(docs, marks, "quality", 50).collect()}) == 50


def test_quality(spark, labelled):
    docs, marks = labelled
    model = quality_crf.train(docs, marks)
    got = {r["doc_id"]: r for r in quality_crf.score(docs, model).collect()}
    held = [i for i, q, _ in corpus()[1] if q is not None and i in got]
    right = np.mean([(got[i]["score"] >= 0.3) == q for i, q, _ in corpus()[1] if i in held])
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got[3]["lines"]) == 3 and got[1000]["score"] == got[1001]["score"] and None in got
    kept = quality_crf.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality_crf.score(docs, model).where("score >= 0.3").count()
    assert quality_crf.score(table(spark, []), model).count() == 0
    assert quality_crf.train(docs, marks.where("quality = 1")) is None
    assert quality_crf.score(docs, None).where("score != 1").count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"One two.\n\nOne two.", b"\n", b"A" * 50, "é ü\nx".encode(), b"a a a a a a"]
    together, per_text, _ = quality_crf.line_features(texts)
    apart = np.concatenate([quality_crf.line_features([t])[0] for t in texts])
    assert np.allclose(together, apart) and per_text.tolist() == [1, 3, 2, 1, 2, 1]


def test_toxicity(spark, labelled):
    docs, marks = labelled
    model = toxicity.train(docs, marks)
    assert any("zorgling".startswith(s) for s in model.lexicon.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in corpus()[1] if i in got and t is not None and i is not None])
    assert right > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] < 0.5 and None in got
    assert toxicity.score(table(spark, []), model).count() == 0
    assert toxicity.train(docs, marks.where("toxic = 1")) is None
    assert toxicity.score(docs, None).where("score != 0").count() == 0


def test_toxicity_features():
    traits = toxicity.TokenTraits(toxicity.Lexicon())
    of = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, traits)))
    assert of("you are an idiot")["lexicon_hit"] == 1 and of("you are an idiot")["near_second_person"] == 0.25
    for hidden in ("1d10t", "i.d.i.o.t", "idiooot", "m0r0n", "$tupid", "l-o-s-e-r"):
        assert of(f"such {hidden} here")["disguised_hit"] == 1, hidden
    assert of("plain words, 2024 items at 10:30")["disguised_hit"] == 0
    assert of("")["words"] == 0 and of(" ".join(WORDS))["lexicon_hit"] == 0
