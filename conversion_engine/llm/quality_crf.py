"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.llm import common
from conversion_engine.llm.labels import training_sample

_SYMBOLS = b"#*$%&|<>{}[]~^=_@\\/+"
_CLASSES = 6  # other, capital, digit, symbol, shout, pause
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(_SYMBOLS)] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b".,;:")] = 5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Rates that also enter as steps, so that the model need not be linear in them.
_STEPS = (0.05, 0.15, 0.3, 0.6)


def _counts(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[end] - total[start]).astype(np.float64)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lines per text, bytes per line) of all lines of some texts, each with its neighbours' features."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    per_text, n_words, repeats, stutters, windows, earlier, closed, starts, ends = [], [], [], [], [], [], [], [], []
    at = 0
    every, bounds = common.hashed_words(texts)
    for text, low, high in zip(texts, bounds[:-1], bounds[1:]):
        lines, seen = text.split(b"\n"), set()
        per_text.append(len(lines))
        sizes, hashes = [], []
        for line in lines:
            starts.append(at)
            at += len(line) + 1
            ends.append(at - 1)
            words = line.split()
            sizes.append(len(words))
            hashes.append(words)
            bare = line.strip()
            earlier.append(bool(bare) and bare in seen)
            seen.add(bare)
            closed.append(bare[-1:] in (b".", b"!", b"?") if bare else False)
        words = every[low:high]
        n_words += sizes
        repeats += [1 - len(set(line)) / len(line) if line else 0.0 for line in hashes]
        line_of = np.repeat(np.arange(len(lines)), sizes)
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
        triple = np.zeros(len(words))
        if len(words) >= 3:
            grams = common.window_hashes(words, 3)
            _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
            triple[:len(grams)] = count[back] > 1
        size = np.maximum(np.array(sizes), 1)
        stutters.append(np.bincount(line_of, same, len(lines)) / size)
        windows.append(np.bincount(line_of, triple, len(lines)) / size)
    start, end = np.array(starts), np.array(ends)
    length = (end - start).astype(np.float64)
    chars = np.maximum(length, 1)
    kinds = _CLASS[buffer]
    capital, digit, symbol, shout, pause = [_counts(kinds == k, start, end) for k in range(1, _CLASSES)]
    letters = np.maximum(_counts(_LETTER[buffer], start, end), 1)
    words = np.array(n_words, np.float64)
    rates = np.stack([capital / letters, symbol / chars, shout / chars, digit / chars, np.array(repeats),
                      np.concatenate(stutters), np.concatenate(windows)], axis=1)
    steps = (rates[:, :, None] > np.array(_STEPS)).reshape(len(rates), -1)
    total = np.repeat(np.add.reduceat(words, np.concatenate([[0], np.cumsum(per_text)[:-1]])), per_text)
    own = np.column_stack([
        rates, steps, pause / chars, np.minimum(length / np.maximum(words, 1) / 10, 3), np.log1p(words), np.log1p(total),
        total < 50, np.array(earlier), np.array(closed), words == 0])
    first = np.zeros(len(own), bool)
    first[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = True
    last = np.roll(first, -1)
    before, after = np.roll(rates, 1, axis=0), np.roll(rates, -1, axis=0)
    before[first], after[last] = 0, 0
    return (np.column_stack([own, before, after, first, last, np.ones(len(own))]).astype(np.float64),
            np.array(per_text), length)


def chains(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and length of every chain, the longest first."""
    by = np.argsort(-per_text, kind="stable")
    return np.concatenate([[0], np.cumsum(per_text)[:-1]])[by], per_text[by]


def forward_backward(emission: np.ndarray, change: np.ndarray, first: np.ndarray, length: np.ndarray):
    """(P(good) of every line, expected counts of neighbouring labels, log Z) of all chains at once.

    ``emission`` is the log odds of a line alone, ``change`` the 2 x 2 scores of neighbours.
    """
    n = len(emission)
    # Scaled so that the larger of the two is one: long runs of strong lines don't overflow.
    psi = np.exp(np.column_stack([np.minimum(0, -emission), np.minimum(0, emission)]))
    move = np.exp(change - change.max())
    alpha, scale = np.empty((n, 2)), np.empty(n)
    alive = np.searchsorted(-length, -np.arange(length[0]) , side="left")  # chains longer than t
    for t in range(length[0]):
        i = first[:alive[t]] + t
        a = psi[i] if t == 0 else (alpha[i - 1] @ move) * psi[i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i, None]
    beta, pairs = np.ones((n, 2)), np.zeros((2, 2))
    for t in range(length[0] - 2, -1, -1):
        i = first[:alive[t + 1]] + t
        ahead = psi[i + 1] * beta[i + 1] / scale[i + 1, None]
        pairs += move * (alpha[i].T @ ahead)
        beta[i] = ahead @ move.T
    good = alpha[:, 1] * beta[:, 1] / (alpha * beta).sum(axis=1)
    log_z = np.log(scale).sum() + np.maximum(0, emission).sum() + change.max() * (n - len(first))
    return good, pairs, log_z


@dataclass
class LineModel:
    """A trained field: standardised features' weights, and the scores of neighbouring labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray

    def good(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return forward_backward((features - self.mean) / self.scale @ self.weights, self.change, *chains(per_text))[0]


def fit(features: np.ndarray, per_text: np.ndarray, good: np.ndarray, steps: int = 60, ridge: float = 2.0) -> LineModel:
    """Maximum likelihood with a ridge penalty, by L-BFGS. All lines of a text carry its label."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    constant = scale < 1e-9
    mean[constant], scale[constant] = 0, 1
    x = (features - mean) / scale
    y = np.repeat(good, per_text).astype(np.float64)
    first, length = chains(per_text)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - 1] = False  # lines with a neighbour below
    here, there = y[inner], y[np.flatnonzero(inner) + 1]
    seen = np.array([[((1 - here) * (1 - there)).sum(), ((1 - here) * there).sum()],
                     [(here * (1 - there)).sum(), (here * there).sum()]])

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        emission, change = x @ theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, log_z = forward_backward(emission, change, first, length)
        value = log_z - (y * emission).sum() - (seen * change).sum() + ridge / 2 * (theta ** 2).sum()
        return value, np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) + ridge * theta

    theta = np.zeros(x.shape[1] + 4)
    value, slope = loss(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = slope.copy(), []
        for s, g in reversed(moves):
            a = (s @ direction) / (s @ g)
            used.append(a)
            direction -= a * g
        if moves:
            s, g = moves[-1]
            direction *= (s @ g) / (g @ g)
        else:
            direction /= max(1.0, np.abs(slope).max())
        for (s, g), a in zip(moves, reversed(used)):
            direction += s * (a - (g @ direction) / (s @ g))
        step, fall = 1.0, slope @ direction
        while step > 1e-6:
            new_value, new_slope = loss(theta - step * direction)
            if new_value <= value - 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        s, g = -step * direction, new_slope - slope
        if s @ g > 1e-10:
            moves = [*moves[-7:], (s, g)]
        done = value - new_value < 1e-5 * abs(value)
        theta, value, slope = theta + s, new_value, new_slope
        if done:
            break
    return LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, id_column: str = "doc_id",
          text_column: str = "text") -> LineModel | None:
    """A model from at most ``most`` labelled documents of the training fold (:func:`labels.training_sample`).

    Features are computed on the executors; those of the sample's lines, a bounded table, are fitted on the driver.
    None if the sample does not hold both labels.
    """
    sample = training_sample(docs, labels, label, most, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            x, per_text, _ = line_features(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(per_text, pa.int32()),
                 pa.array([rows.astype("<f4").tobytes() for rows in np.split(x, np.cumsum(per_text)[:-1])], pa.binary())],
                names=["_id", "_label", "_lines", "_features"])

    schema = sample.select("_id", "_label").schema.add("_lines", "integer").add("_features", "binary")
    rows = sample.select("_id", F.col("_text").cast("binary"), "_label").mapInArrow(run, schema).toArrow().sort_by("_id")
    good = rows.column("_label").to_numpy() > 0
    if len(good) == 0 or good.all() or not good.any():
        return None
    per_text = rows.column("_lines").to_numpy()
    x = np.frombuffer(b"".join(rows.column("_features").to_pylist()), "<f4").reshape(per_text.sum(), -1)
    return fit(x.astype(np.float64), per_text, good)


def _scores(texts: list[bytes], model: LineModel | None):
    """(score of every text, P(good) of every line, where each text's lines begin and the last one's end)."""
    x, per_text, length = line_features(texts)
    good = model.good(x, per_text) if model else np.ones(len(x))
    weight = np.maximum(length, 1)
    edges = np.concatenate([[0], np.cumsum(per_text)])
    total = np.add.reduceat(good * weight, edges[:-1]) / np.add.reduceat(weight, edges[:-1])
    return np.clip(total, 0, 1), good, edges


def score(docs: DataFrame, model: LineModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id_column``, score, lines): the probability that a text is good, and that of each of its lines.

    Lines are between line feeds. A text's score is the mean of its lines' probabilities, which see the
    whole text, weighted by their length in bytes. Whole texts are scored, a row for each row of
    ``docs``. NULL and empty texts are one empty line. Without a model every score is 1. Other columns are ignored.
    """
    schema = docs.select(f"`{id_column}`").schema.add("score", "double").add("lines", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            total, good, edges = _scores([t or b"" for t in part.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(good))],
                names=[id_column, "score", "lines"])

    return docs.select(f"`{id_column}`", F.col(f"`{text_column}`").cast("binary")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: LineModel | None, least: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a score of ``least`` or more. No shuffle; cases as in :func:`score`."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
            good = _scores(texts, model)[0] >= least
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
