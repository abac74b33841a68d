"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common
from conversion_engine.llm.labels import training_sample

#: Insults, in English, German, French and Spanish; the training fold adds its own.
SEED_WORDS = frozenset("""
    idiot idiots moron morons loser losers stupid dumb scum trash garbage pathetic worthless disgusting clown
    imbecile bastard bitch asshole shit fuck fucking crap freak jerk retard ugly
    dumm blöd trottel arschloch scheiße abschaum dreck versager
    stupide imbécile connard salaud merde ordure débile
    estúpido imbécil basura asqueroso mierda pendejo cabrón
""".split())
SECOND_PERSON = frozenset("""
    you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen
    tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro
""".split())
#: What stands for a letter in a disguised word.
LEET = str.maketrans("013457@$!|€", "oieasta" + "siie")
_INNER = str.maketrans("", "", ".-_*'’·~ ")
FEATURES = ("words", "lexicon_density", "lexicon_distinct", "lexicon_hit", "stem_density", "stem_hit", "disguised_density",
            "disguised_hit", "near_second_person", "second_person_density", "capital_words", "capital_letters",
            "shout_rate", "punctuation_rate", "odd_word_rate", "stretched_rate")


@dataclass(frozen=True)
class Lexicon:
    """Words, and beginnings of words, that mark toxic texts."""

    words: frozenset[str] = SEED_WORDS
    stems: frozenset[str] = frozenset()

    def kind(self, word: str) -> int:
        """1 for a listed word, 2 for a listed beginning, else 0."""
        if word in self.words:
            return 1
        return 2 * any(word[:n] in self.stems for n in STEMS if len(word) >= n)


#: A known token costs some 250 bytes of a Python worker.
CACHED_TOKENS = 300_000
#: Lengths of beginnings.
STEMS = (4, 5, 6, 7, 8)


_EDGES = re.compile(r"^\W+|\W+$")


def bare(token: str) -> str:
    return _EDGES.sub("", token).lower()


def _squeezed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if not i or c != word[i - 1])


_STRETCHED = re.compile(r"(.)\1\1", re.S)


class TokenTraits(dict):
    """Nine numbers for each token, worked out once for each distinct one. Maps a token to its row of ``table``."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.table = lexicon, np.zeros((1024, 9), np.float32)

    def __missing__(self, token: str) -> int:
        plain = token.isalpha()
        word = token.lower() if plain else bare(token)
        kind, hidden = self.lexicon.kind(word), False
        stretched = _STRETCHED.search(word) is not None
        if not kind and word and not (plain and not stretched):
            shown = bare(token.lower().rstrip(".,;:!?").translate(_INNER).translate(LEET))
            if shown != word or stretched:
                hidden = bool(self.lexicon.kind(shown) or _squeezed(shown) in self.lexicon.words)
        letters = len(token) if plain else sum(map(str.isalpha, token))
        upper = 0 if token.islower() else sum(map(str.isupper, token))
        odd = not plain and not word.isalpha() and any(map(str.isalpha, word))
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = (kind == 1, kind == 2, hidden, word in SECOND_PERSON, letters > 1 and upper and token.isupper(),
                         upper, letters, odd, stretched)
        self[token] = n
        return n


def features(text: str, traits: TokenTraits) -> list[float]:
    """The dense features named in ``FEATURES``; all zero for an empty text."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    at = np.fromiter(map(traits.__getitem__, tokens), np.int64, n)
    table = traits.table[at]
    word, stem, hidden, second, capital, upper, letters, odd, stretched = table.sum(axis=0, dtype=np.float64).tolist()
    near, distinct = 0.0, 0
    if word or stem or hidden:
        marked = np.flatnonzero(table[:, :3].any(axis=1))
        persons = np.flatnonzero(table[:, 3])
        if len(persons):
            place = np.searchsorted(persons, marked)
            gap = np.minimum(np.abs(persons[np.minimum(place, len(persons) - 1)] - marked),
                             np.abs(persons[np.maximum(place - 1, 0)] - marked))
            near = float(1 / (1 + gap.min()))
        distinct = len({bare(tokens[i]) for i in marked})
    size = len(text)
    return [float(np.log1p(n)), word / n, float(distinct), float(word > 0), stem / n, float(stem > 0), hidden / n,
            float(hidden > 0), near, second / n, capital / n, upper / max(letters, 1),
            (text.count("!") + text.count("?")) / size, sum(map(text.count, ".,;:-")) / size, odd / n, stretched / n]


def _featured(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` (first the text) without the text, and features."""
    schema = docs.select(*keep[1:]).schema.add("_features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traits = TokenTraits(lexicon)
        for part in common.slices(batches):
            rows = []
            for text in part.column(0).to_pylist():
                if len(traits) > CACHED_TOKENS:
                    traits = TokenTraits(lexicon)
                rows.append(features(text or "", traits))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(rows, pa.list_(pa.float64()))],
                                             names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame, most: int = 200, least: int = 5, clean_share: float = 0.1) -> Lexicon:
    """The seed, and the words and beginnings of ``least`` toxic texts or more, and at most ``clean_share`` as many others.

    ``sample`` has _text and _label. The ``most`` frequent words and as many beginnings come back.
    """
    words = F.array_distinct(F.transform(F.split(F.lower("_text"), common.SPACES),
                                         lambda w: F.regexp_replace(w, r"^\P{L}+|\P{L}+$", "")))
    def starts(n: int) -> Column:
        return F.transform(F.filter("_words", lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))

    beginnings = F.array_distinct(F.flatten(F.array(*map(starts, STEMS))))
    listed = sample.select("_label", words.alias("_words"))
    sides = [listed.select("_label", F.lit(0).alias("_stem"), F.explode("_words").alias("_w")),
             listed.select("_label", F.lit(1).alias("_stem"), F.explode(beginnings).alias("_w"))]
    counts = sides[0].union(sides[1]).where("_w != ''").groupBy("_stem", "_w").agg(
        F.sum("_label").alias("t"), F.sum(1 - F.col("_label")).alias("c")).where(F.col("t") >= least)
    kept = counts.where(F.col("c") + 0.5 <= clean_share * (F.col("t") + 0.5)).select("_stem", "_w", "t")
    found = [kept.where(F.col("_stem") == stem).orderBy(F.desc("t"), "_w").limit(most).collect() for stem in (0, 1)]
    return Lexicon(SEED_WORDS | {r["_w"] for r in found[0]}, frozenset(r["_w"] for r in found[1]))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 12000, id_column: str = "doc_id",
          text_column: str = "text", iterations: int = 12, depth: int = 4) -> ToxicityModel | None:
    """A model from at most ``most`` labelled documents of the training fold (:func:`labels.training_sample`).

    Half of them give the lexicon, three tenths the trees, so that these see words as reliable as they will be
    on new texts, and two tenths the calibration. None if a part does not hold both labels.
    """
    shelf = common.Shelf(docs.sparkSession, "toxicity")
    tenth = F.pmod(F.xxhash64(F.lit(3), "_id"), 10)
    part = F.when(tenth < 5, "lexicon").when(tenth < 8, "trees").otherwise("calibration")
    sample = shelf.put(training_sample(docs, labels, label, most, id_column, text_column).withColumn("_part", part), "sample")
    if sample.select("_part", F.col("_label") > 0).distinct().count() < 6:
        return None
    lexicon = learn_lexicon(sample.where("_part = 'lexicon'"))
    rows = shelf.put(_featured(sample.where("_part != 'lexicon'"), lexicon, ["_text", "_id", "_label", "_part"]), "features") \
        .withColumn("_vector", array_to_vector("_features"))
    trees = GBTClassifier(featuresCol="_vector", labelCol="_label", maxIter=iterations, maxDepth=depth, stepSize=0.3,
                          seed=7).fit(rows.where("_part = 'trees'").coalesce(2))
    judged = trees.transform(rows.where("_part = 'calibration'")).select(
        "_label", vector_to_array("probability")[1].alias("_raw_score"))
    calibration = IsotonicRegression(featuresCol="_raw_score", labelCol="_label", predictionCol="_calibrated").fit(judged)
    shelf.keep()
    return ToxicityModel(lexicon, trees, calibration)


def score(docs: DataFrame, model: ToxicityModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id_column``, score, features): the calibrated probability that a text is toxic, from its whole text.

    A row for each row of ``docs``, NULL ids and repeated rows included. NULL and empty texts have features of zero.
    Without a model every score is 0. Other columns are ignored.
    """
    source = docs.select(F.col(f"`{text_column}`").alias("_text"), F.col(f"`{id_column}`").alias("_id"))
    found = _featured(source, model.lexicon if model else Lexicon(), ["_text", "_id"])
    if model is None:
        return found.select(F.col("_id").alias(id_column), F.lit(0.0).alias("score"), F.col("_features").alias("features"))
    judged = model.trees.transform(found.withColumn("_vector", array_to_vector("_features"))) \
        .withColumn("_raw_score", vector_to_array("probability")[1])
    return model.calibration.transform(judged).select(
        F.col("_id").alias(id_column), F.col("_calibrated").alias("score"), F.col("_features").alias("features"))
