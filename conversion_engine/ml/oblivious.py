"""Gradient boosting with oblivious trees: one split a level for all nodes of a tree.

Rows are kept as blocks: a block holds the bins of many rows, their labels, weights and margins as packed
arrays. A level of a tree is one aggregate over the blocks, the sums of gradients per feature, bin and leaf. Sums are
integers (fixed point), so that a tree doesn't depend on partitions, task retries or where training was cut in rounds.
What reaches the driver is one row per feature, the best split of each; trees are model-sized and go with the tasks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.session import discard, run_folder

#: Gradients, weights and losses are rounded to this part of one before they are summed.
UNIT = float(1 << 24)
_HISTOGRAM, _LOSS, _LEAVES, _CUT = 0, 1, 2, 3
#: Cells (rows times features) that a partition of blocks should hold at least.
PARTITION_CELLS = 32 << 20
#: Features of few bins are counted together, up to so many cells; rows in pieces whose sums stay in a core's cache.
JOINT_CELLS, PIECE_ROWS = 1 << 10, 1 << 16
_BLOCK = "_split int, _n int, _bins binary, _y binary, _w binary, _m binary"
_PART = "_kind int, _key int, _data binary"
_BEST = "_kind int, _key int, _bin int, _gain double, _data binary"
TRAIN, VALIDATION = 0, 1
Batches = Iterator[pa.RecordBatch]


@dataclass
class Tree:
    """Splits (feature, bin, border, gain) from the first level on, and leaf values and weights.

    Bit l of a leaf's number says whether the row lies above the border of level l.
    """

    splits: list[tuple[int, int, float, float]]
    values: np.ndarray
    weights: np.ndarray | None = None

    def leaves(self, columns: Callable[[int], np.ndarray], rows: int, binned: bool) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        for level, (feature, cut, border, _) in enumerate(self.splits):
            out |= (columns(feature) > (cut if binned else border)).astype(np.int64) << level
        return out


@dataclass
class Trees:
    """An ensemble over the columns ``features``."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def first(self, count: int) -> Trees:
        return Trees(self.features, self.trees[:count])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, level, feature, border, gain): a row per level of every tree."""
        rows = [(t, l, self.features[f], b, g) for t, tree in enumerate(self.trees)
                for l, (f, _, b, g) in enumerate(tree.splits)]
        return spark.createDataFrame(rows, "tree int, level int, feature string, border double, gain double")

    def leaves(self, spark: SparkSession) -> DataFrame:
        """(tree, leaf, value, weight): the leaves, with the weight of the training rows in them."""
        rows = [(t, leaf, float(v), float(w)) for t, tree in enumerate(self.trees)
                for leaf, (v, w) in enumerate(zip(tree.values, tree.weights))]
        return spark.createDataFrame(rows, "tree int, leaf int, value double, weight double")

    @classmethod
    def from_tables(cls, features: list[str], nodes: DataFrame, leaves: DataFrame) -> Trees:
        """The ensemble that ``nodes`` and ``leaves``, tables of the model's size, describe."""
        at = {name: i for i, name in enumerate(features)}
        splits, values, weights = defaultdict(dict), defaultdict(dict), defaultdict(dict)
        for r in nodes.collect():
            splits[r["tree"]][r["level"]] = (at[r["feature"]], -1, r["border"], r["gain"])
        for r in leaves.collect():
            values[r["tree"]][r["leaf"]], weights[r["tree"]][r["leaf"]] = r["value"], r["weight"]
        dense = lambda by: np.array([by[i] for i in range(len(by))])
        return cls(features, [Tree([splits[t][l] for l in range(len(splits[t]))], dense(values[t]), dense(weights[t]))
                              for t in sorted(values)])

    def leaf_numbers(self, columns: Sequence[pa.Array]) -> Iterator[np.ndarray]:
        """The leaves that rows reach, tree by tree; ``columns`` are those of the features, in their order."""
        made: dict[int, np.ndarray] = {}

        def column(feature: int) -> np.ndarray:
            if feature not in made:
                made[feature] = numbers(columns[feature])
            return made[feature]
        rows = len(columns[0]) if columns else 0
        for tree in self.trees:
            yield tree.leaves(column, rows, False)

    def margin(self, columns: Sequence[pa.Array]) -> np.ndarray:
        out = np.zeros(len(columns[0]))
        for tree, leaf in zip(self.trees, self.leaf_numbers(columns)):
            out += tree.values[leaf]
        return out

    def score_column(self) -> Column:
        """The probability of the positive class, from the columns named like the features."""
        @F.arrow_udf("double")
        def score(*columns: pa.Array) -> pa.Array:
            return pa.array(sigmoid(self.margin(columns)))
        return score(*map(quoted, self.features))


def numbers(column: pa.Array) -> np.ndarray:
    """A missing value lies below every border."""
    out = column.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(out), -np.inf, out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fixed(x: np.ndarray) -> np.ndarray:
    """Rounded to the unit of the sums; a double's integers up to 2^53 are exact."""
    return np.rint(x * UNIT)


def row_losses(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, np.where(label > 0, -margin, margin))


def feature_borders(rows: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Cuts of each feature at even shares of its rows, ``max_bins`` - 1 at most; none of a constant."""
    known = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in map(quoted, features)]
    # One column for all features: a list would be sent to the JVM number by number, for each of them.
    shares = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    facts = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"p{i}") for i, c in enumerate(known)],
                     *[F.max(c).alias(f"m{i}") for i, c in enumerate(known)]).first()
    return [np.array([c for c in sorted(set(facts[f"p{i}"] or [])) if c < facts[f"m{i}"]]) for i in range(len(features))]


def quoted(name: str) -> str:
    return f"`{name}`"


def _blocks(borders: list[np.ndarray]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            splits = batch.column("_split").to_numpy()
            bins = np.stack([np.searchsorted(cut, numbers(batch.column(f"_{i}"))) for i, cut in enumerate(borders)]).astype(np.uint8) \
                if borders else np.zeros((0, batch.num_rows), np.uint8)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_w"))
            for split in np.unique(splits):
                rows = np.flatnonzero(splits == split)
                yield pa.RecordBatch.from_pydict({
                    "_split": pa.array([int(split)], pa.int32()), "_n": pa.array([len(rows)], pa.int32()),
                    "_bins": [bins[:, rows].tobytes()], "_y": [y[rows].astype(np.uint8).tobytes()],
                    "_w": [w[rows].tobytes()], "_m": [np.zeros(len(rows)).tobytes()]})
    return run


@dataclass
class _Block:
    split: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    m: np.ndarray


def _unpacked(batches: Batches) -> Iterator[_Block]:
    for batch in batches:
        for split, n, bins, y, w, m in zip(*(batch.column(c).to_pylist() for c in ("_split", "_n", "_bins", "_y", "_w", "_m"))):
            yield _Block(split, np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(y, np.uint8),
                         np.frombuffer(w), np.frombuffer(m))


def _advanced(block: _Block, pending: list[Tree]) -> tuple[np.ndarray, np.ndarray | None]:
    """Margins after the pending trees, and the leaves of the last of them."""
    margin, leaf = block.m, None
    for tree in pending:
        leaf = tree.leaves(lambda f: block.bins[f], len(block.y), True)
        margin = margin + tree.values[leaf]
    return margin, leaf


def _advancer(pending: list[Tree]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            margins = [_advanced(block, pending)[0].tobytes() for block in _unpacked(iter([batch]))]
            yield batch.set_column(batch.schema.get_field_index("_m"), "_m", pa.array(margins, pa.binary()))
    return run


class _Facts:
    """Losses per split, and the weight in each leaf of the last tree, summed over blocks."""

    def __init__(self, pending: list[Tree]):
        self.losses, self.weights, self.leaves = defaultdict(lambda: np.zeros(2)), None, len(pending[-1].values) if pending else 0

    def add(self, block: _Block, margin: np.ndarray, last: np.ndarray | None) -> None:
        self.losses[block.split] += [fixed(block.w * row_losses(margin, block.y)).sum(), fixed(block.w).sum()]
        if last is not None and block.split == TRAIN:
            found = np.bincount(last, fixed(block.w), self.leaves)
            self.weights = found if self.weights is None else self.weights + found

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for split, values in self.losses.items():
            yield _LOSS, split, values.astype(np.int64)
        if self.weights is not None:
            yield _LEAVES, 0, self.weights.astype(np.int64)


def _gradients(block: _Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    return fixed(block.w * (block.y - p)), fixed(block.w * p * (1 - p))


def _histogram(bins: np.ndarray, count: int, leaf: np.ndarray, leaves: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradient and hessian sums [2, leaves * bins] of one feature."""
    at = leaf * count + bins
    return np.stack([np.bincount(at, g, count * leaves), np.bincount(at, h, count * leaves)])


def _collector(bins: list[int], pending: list[Tree], partial: Tree | None, facts: bool) -> Callable[[Batches], Batches]:
    """Per task: histograms of the level below ``partial``; with ``facts``, losses and the leaf weights of the last tree."""
    def run(batches: Batches) -> Batches:
        leaves, met = 1 << len(partial.splits) if partial else 0, _Facts(pending)
        offsets = np.concatenate([[0], np.cumsum(bins)]).astype(np.int64) * leaves
        sums = np.zeros((2, int(offsets[-1])))
        for block in _unpacked(batches):
            margin, last = _advanced(block, pending)
            if facts:
                met.add(block, margin, last)
            if partial and block.split == TRAIN:
                g, h = _gradients(block, margin)
                leaf = partial.leaves(lambda f: block.bins[f], len(block.y), True)
                for feature, count in enumerate(bins):
                    if count > 1:
                        sums[:, offsets[feature]:offsets[feature + 1]] += _histogram(block.bins[feature], count, leaf, leaves, g, h)
        rows = list(met.rows())
        for feature, count in enumerate(bins if partial else []):
            mine = sums[:, offsets[feature]:offsets[feature + 1]]
            cells = np.flatnonzero(mine.any(0))
            if count > 1:
                rows.append((_HISTOGRAM, feature, np.concatenate([cells, *mine[:, cells].astype(np.int64)]).astype(np.int64)))
        yield pa.RecordBatch.from_pydict({
            "_kind": pa.array([r[0] for r in rows], pa.int32()), "_key": pa.array([r[1] for r in rows], pa.int32()),
            "_data": pa.array([r[2].tobytes() for r in rows], pa.binary())})
    return run


def _best_rows(rows: list[tuple[int, int, int, float, np.ndarray]]) -> pa.RecordBatch:
    kinds, keys, cuts, gains, data = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "_kind": pa.array(kinds, pa.int32()), "_key": pa.array(keys, pa.int32()), "_bin": pa.array(cuts, pa.int32()),
        "_gain": pa.array(gains, pa.float64()), "_data": pa.array([d.tobytes() for d in data], pa.binary())})


def leaf_values(sums: np.ndarray, learning_rate: float, l2: float) -> np.ndarray:
    """Values of the leaves, for gradient and hessian sums [2, leaves]."""
    g, h = sums.reshape(2, -1) / UNIT
    return learning_rate * g / (h + l2)


def joint_groups(bins: list[int]) -> list[list[int]]:
    """The features that can be split, those of few bins in groups: one histogram of a group holds those of its features."""
    groups, cells = [], 0
    for feature in sorted((f for f, count in enumerate(bins) if count > 1), key=lambda f: bins[f]):
        if groups and cells * bins[feature] <= JOINT_CELLS:
            groups[-1].append(feature)
            cells *= bins[feature]
        else:
            groups.append([feature])
            cells = bins[feature]
    return groups


class _Counter:
    """Gradient and hessian sums per feature, bin and leaf of a growing tree, over the rows of one task.

    From the second level on only the lighter side of each split is counted; the other side is the rest of its leaf.
    A row's gradient and hessian are one complex number, so that both are added at once; its parts are integers, exact up to 2^53.
    """

    def __init__(self, bins: np.ndarray, counts: list[int]):
        self.bins, self.counts, self.groups = bins, counts, joint_groups(counts)
        self.joint = []
        for features in self.groups:
            column = bins[features[0]].astype(np.uint16)
            for f in features[1:]:
                column = column * np.uint16(counts[f]) + bins[f]
            self.joint.append(column)

    def start(self, g: np.ndarray, h: np.ndarray) -> None:
        self.both = np.empty(len(g), complex)
        self.both.real, self.both.imag = g, h
        self.leaf, self.known, self.leaves = np.zeros(len(g), np.int64), {}, 1

    def _counted(self, chosen: np.ndarray | None) -> dict[int, np.ndarray]:
        cells = [int(np.prod([self.counts[f] for f in features])) for features in self.groups]
        sums = [np.zeros(self.leaves * c, complex) for c in cells]
        for start in range(0, len(self.both), PIECE_ROWS):
            piece = slice(start, start + PIECE_ROWS)
            both, leaf = self.both[piece], self.leaf[piece]
            rows = None if chosen is None else np.flatnonzero(chosen[piece])
            if rows is not None:
                both, leaf = both[rows], leaf[rows]
            first = {count: leaf * count for count in set(cells)}  # the first cell of each row's leaf
            for column, count, total in zip(self.joint, cells, sums):
                np.add.at(total, first[count] + (column[piece] if rows is None else column[piece].take(rows)), both)
        out = {}
        for features, total in zip(self.groups, sums):
            shaped = np.stack([total.real, total.imag]).astype(np.int64).reshape(2, self.leaves, *[self.counts[f] for f in features])
            for i, f in enumerate(features):
                out[f] = shaped.sum(tuple(a for a in range(2, shaped.ndim) if a != i + 2))
        return out

    def first(self) -> dict[int, np.ndarray]:
        """Sums [2, leaves, bins] of each feature, before any split."""
        self.known = self._counted(None)
        return self.known

    def split(self, feature: int, cut: int, sums: np.ndarray) -> dict[int, np.ndarray]:
        """The sums after all leaves are split by ``feature`` at ``cut``; ``sums`` [2, 2, leaves] are those below and above."""
        above, lighter = self.bins[feature] > cut, sums[1, 1] <= sums[1, 0]
        counted, side = self._counted(above == lighter[self.leaf]), lighter[None, :, None]
        for f, part in counted.items():
            rest = self.known[f] - part
            self.known[f] = np.concatenate([np.where(side, rest, part), np.where(side, part, rest)], 1)
        self.leaf += above * self.leaves
        self.leaves *= 2
        return self.known


def _whole(blocks: list[_Block], split: int) -> _Block | None:
    mine = [b for b in blocks if b.split == split]
    return _Block(split, *[np.concatenate([getattr(b, c) for b in mine], -1) for c in ("bins", "y", "w", "m")]) if mine else None


def _grower(bins: list[int], pending: list[Tree], trees: int, depth: int, learning_rate: float, l2: float) -> Callable[[Batches], Batches]:
    """Up to ``trees`` trees, where one task has all blocks: its sums are whole, so that the cuts can be chosen there.

    Keys are 2^8 times the tree's number plus the level or split: for each level its cut (bin, gain, and [feature, sums below
    and above]), then losses and leaf weights after the tree.
    """
    def cuts(counter: _Counter) -> Iterator[tuple[int, int, float, np.ndarray]]:
        known = counter.first()
        for level in range(depth):
            best = None
            for feature in sorted(known):
                cut, gain, values = best_cut(known[feature], l2)
                if best is None or gain > best[2]:
                    best = feature, cut, gain, values
            if best is None or best[2] <= 0:
                return
            yield best
            if level < depth - 1:
                known = counter.split(best[0], best[1], best[3])

    def run(batches: Batches) -> Batches:
        found = list(_unpacked(batches))
        blocks = [b for b in (_whole(found, TRAIN), _whole(found, VALIDATION)) if b]
        found.clear()
        if not blocks or blocks[0].split != TRAIN:
            return
        for block in blocks:
            block.m = _advanced(block, pending)[0]
        counter, rows = _Counter(blocks[0].bins, bins), []
        for number in range(trees):
            tree = Tree([], np.zeros(1))
            counter.start(*_gradients(blocks[0], blocks[0].m))
            for feature, cut, gain, values in cuts(counter):
                rows.append((_CUT, (number << 8) + len(tree.splits), cut, gain, np.concatenate([[feature], values.ravel()]).astype(np.int64)))
                tree.splits.append((feature, cut, 0.0, gain))
                tree.values = leaf_values(values, learning_rate, l2)
            if not tree.splits:
                break
            met = _Facts([tree])
            for block in blocks:
                leaf = tree.leaves(lambda f: block.bins[f], len(block.y), True)
                block.m = block.m + tree.values[leaf]
                met.add(block, block.m, leaf)
            rows += [(kind, (number << 8) + key, -1, 0.0, values) for kind, key, values in met.rows()]
        if rows:
            yield _best_rows(rows)
    return run


def best_cut(sums: np.ndarray, l2: float) -> tuple[int, float, np.ndarray]:
    """The cut of the largest gain, for gradient and hessian sums [2, leaves, bins]; the gain; and the sums [2, 2, leaves] below and above it."""
    below = sums.cumsum(2)[:, :, :-1]
    total = sums.sum(2)
    above = total[:, :, None] - below

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return ((g / UNIT) ** 2 / (h / UNIT + l2)).sum(0)
    gains = score(*below) + score(*above) - score(*total)
    cut = int(gains.argmax())
    return cut, float(gains[cut]), np.stack([below[:, :, cut], above[:, :, cut]], 1)


def _merger(bins: list[int], leaves: int, l2: float) -> Callable[[Batches], Batches]:
    """Sums per key; of a feature's histogram, its best cut."""
    def run(batches: Batches) -> Batches:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, key, data in zip(*(batch.column(c).to_pylist() for c in ("_kind", "_key", "_data"))):
                values = np.frombuffer(data, np.int64)
                if kind == _HISTOGRAM:
                    cells, g, h = values.reshape(3, -1)
                    total = found.setdefault((kind, key), np.zeros((2, leaves * bins[key]), np.int64))
                    total[0, cells] += g
                    total[1, cells] += h
                else:
                    found[kind, key] = found[kind, key] + values if (kind, key) in found else values
        rows = []
        for (kind, key), values in found.items():
            cut, gain = -1, 0.0
            if kind == _HISTOGRAM:
                cut, gain, values = best_cut(values.reshape(2, leaves, bins[key]), l2)
            rows.append((kind, key, cut, gain, values))
        if rows:
            yield _best_rows(rows)
    return run


class Booster:
    """Training that can be carried on: trees so far, losses, and the blocks with the margins they give.

    ``rows`` has the numeric columns ``features``, ``label`` (0 or 1), ``weight``, and ``split`` ('train' or 'validation');
    other splits are left out. Missing numbers lie below every border. The same rows give the same trees whatever their order and
    partitions, and whether trees are grown at once or in several calls.
    """

    def __init__(self, rows: DataFrame, features: list[str], learning_rate: float = 0.2, depth: int = 6, patience: int = 50,
                 max_bins: int = 255, l2: float = 3.0, label: str = "label", weight: str = "weight", split: str = "split",
                 borders: list[np.ndarray] | None = None, store_every: int = 8):
        if not 2 <= max_bins <= 256:
            raise ValueError("a bin is a byte")
        self.spark, self.learning_rate, self.depth, self.patience, self.l2 = rows.sparkSession, learning_rate, depth, patience, l2
        self.trees = Trees(list(features))
        self.losses: dict[int, list[float]] = {TRAIN: [], VALIDATION: []}
        self.borders = feature_borders(rows.where(F.col(split) == "train"), features, max_bins) if borders is None else borders
        self.bins = [len(c) + 1 for c in self.borders]
        self.store_every, self.stored, self.stopped = max(1, store_every), 0, False
        number = F.when(F.col(split) == "train", TRAIN).when(F.col(split) == "validation", VALIDATION)
        numeric = [F.col(quoted(c)).cast("double").alias(f"_{i}") for i, c in enumerate(features)]
        plain = rows.select(number.cast("int").alias("_split"), F.col(label).cast("double").alias("_y"),
                            F.col(weight).cast("double").alias("_w"), *numeric).where("_split IS NOT NULL")
        self.blocks, self._path = None, None
        self._part, self._best = T.StructType.fromDDL(_PART), T.StructType.fromDDL(_BEST)
        cells = plain.count() * max(1, len(features))
        made = plain.mapInArrow(_blocks(self.borders), _BLOCK)
        parts = max(1, min(cells // PARTITION_CELLS, made.rdd.getNumPartitions()))
        self._alone = parts == 1
        self._store(made.repartition(parts))

    def _store(self, blocks: DataFrame) -> None:
        """The blocks as a table, which cuts the lineage, kept in memory where it fits."""
        path = f"{run_folder(self.spark)}/boosting-{uuid.uuid4().hex}"
        blocks.write.parquet(path)
        old, old_path = self.blocks, self._path
        read = self.spark.read.schema(_BLOCK).parquet(path)
        # A reader may cut one file in pieces.
        self.blocks, self._path = (read.coalesce(1) if self._alone else read).persist(), path
        self._training = self.blocks.where(F.col("_split") == TRAIN)
        if old is not None:
            old.unpersist()
            discard(self.spark, old_path)

    def close(self) -> None:
        """Give the blocks' memory and files back; no more trees can be grown."""
        if self.blocks is not None:
            self.blocks.unpersist()
            discard(self.spark, self._path)
            self.blocks, self.stopped = None, True

    def _aggregate(self, partial: Tree | None, facts: bool) -> list:
        """One row per feature: its best cut of the next level. With ``facts``, losses and leaf weights after the last tree."""
        blocks = self.blocks if facts else self._training
        collect = _collector(self.bins, self.trees.trees[self.stored:], partial, facts)
        merge = _merger(self.bins, 1 << len(partial.splits) if partial else 0, self.l2)
        return blocks.mapInArrow(collect, self._part).repartition("_kind", "_key").mapInArrow(merge, self._best).collect()

    def _note(self, rows: list) -> None:
        """Losses after the last tree, and whether patience has run out."""
        done = len(self.trees.trees)
        if not done or len(self.losses[TRAIN]) == done:
            return
        for r in rows:
            if r["_kind"] == _LOSS:
                loss, weight = np.frombuffer(r["_data"], np.int64)
                self.losses[r["_key"] & 255].append(float(loss) / float(weight) if weight else float("nan"))
            elif r["_kind"] == _LEAVES:
                self.trees.trees[-1].weights = np.frombuffer(r["_data"], np.int64) / UNIT
        checked = self.losses[VALIDATION]
        if checked and len(checked) - 1 - int(np.argmin(checked)) >= self.patience:
            self.stopped = True

    def _tree(self, cuts: Iterable[tuple[int, int, float, np.ndarray]]) -> Iterator[Tree]:
        """The tree as it grows by ``cuts``: feature, bin, gain, gradient and hessian sums below and above the new border."""
        tree = Tree([], np.zeros(1))
        yield tree
        for feature, bin_, gain, sums in cuts:
            tree.splits.append((feature, bin_, float(self.borders[feature][bin_]), gain))
            # Leaves below the new border come first.
            tree.values = leaf_values(sums, self.learning_rate, self.l2)
            yield tree

    def _cut(self, tree: Tree) -> tuple[int, int, float, np.ndarray] | None:
        """The best cut of the next level: feature, bin, gain, sums; None where none gains.

        The first level comes with the losses after the last tree, which may say that there is none to come.
        """
        found = self._aggregate(tree, not tree.splits)
        if not tree.splits:
            self._note(found)
        cuts = [r for r in found if r["_kind"] == _HISTOGRAM]
        best = max(cuts, key=lambda r: (r["_gain"], -r["_key"]), default=None)
        if self.stopped or best is None or best["_gain"] <= 0:
            return None
        return best["_key"], best["_bin"], best["_gain"], np.frombuffer(best["_data"], np.int64)

    def _add(self, cuts: list[tuple[int, int, float, np.ndarray]]) -> bool:
        """Add the tree of ``cuts``; without any, training is over."""
        if not cuts:
            self.stopped = True
        if not self.stopped:
            *_, tree = self._tree(cuts)
            self.trees.trees.append(tree)
        return not self.stopped

    def _grow_whole(self, trees: int) -> int:
        """Up to ``trees`` trees of one job; those after patience has run out are dropped."""
        pending = self.trees.trees[self.stored:]
        grow = _grower(self.bins, pending, trees, self.depth, self.learning_rate, self.l2)
        found, grown = defaultdict(list), 0
        for r in self.blocks.mapInArrow(grow, self._best).collect():
            found[r["_key"] >> 8].append(r)
        for number in range(trees):
            cuts = sorted((r for r in found[number] if r["_kind"] == _CUT), key=lambda r: r["_key"])
            sums = [np.frombuffer(r["_data"], np.int64) for r in cuts]
            if not self._add([(int(v[0]), r["_bin"], r["_gain"], v[1:]) for r, v in zip(cuts, sums)]):
                break
            grown += 1
            self._note(found[number])
            if self.stopped:
                break
        return grown

    def grow(self, trees: int) -> int:
        """Grow up to ``trees`` more trees; fewer if patience runs out or no split is left. The number grown.

        Where one task has all blocks, it grows several trees in one job; otherwise a level is an aggregate.
        """
        grown = 0
        while grown < trees and not self.stopped:
            # Otherwise the last tree stays pending: its losses and leaf weights are found with the next one's first level.
            pending = self.trees.trees[self.stored:None if self._alone else -1]
            if len(pending) >= self.store_every:
                self._store(self.blocks.mapInArrow(_advancer(pending), _BLOCK))
                self.stored += len(pending)
            if self._alone:
                grown += self._grow_whole(min(trees - grown, 4 * self.store_every))
                continue
            cuts, growing = [], Tree([], np.zeros(1))
            while len(cuts) < self.depth and (cut := self._cut(growing)):
                cuts.append(cut)
                *_, growing = self._tree(cuts)
            grown += self._add(cuts)
        return grown

    def measure(self) -> None:
        """Losses and leaf weights after the last tree, where they are not known yet."""
        if self.trees.trees and len(self.losses[TRAIN]) < len(self.trees.trees):
            self._note(self._aggregate(None, True))

    def best(self) -> int:
        """The number of trees with the lowest validation loss; all, without validation rows."""
        checked = self.losses[VALIDATION]
        return int(np.argmin(checked)) + 1 if checked else len(self.trees.trees)


def fit(rows: DataFrame, features: list[str], iterations: int = 1200, **settings) -> tuple[Trees, int, dict[str, list[float]]]:
    """All trees grown (the best ones and ``patience`` more, at most ``iterations``), the best number, and losses by split."""
    booster = Booster(rows, features, **settings)
    booster.grow(iterations)
    booster.measure()
    losses = {"train": booster.losses[TRAIN]} | ({"validation": booster.losses[VALIDATION]} if booster.losses[VALIDATION] else {})
    booster.close()
    return booster.trees, booster.best(), losses
