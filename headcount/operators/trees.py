"""Decision trees and second-order boosting, grown on binned counts.

Features become bins once. A level of growth is one scan: every task takes its rows
through the trees so far and adds up, for each open node, feature and bin, three sums (of
the two classes and rows, or of gradients, curvatures and rows); Spark adds the sums of
the tasks, and the best split of each node is chosen where its sums meet. The driver holds
splits only. All trees that are asked for grow in the same scans, whatever their settings,
so the reads of the table do not depend on how many there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.operators.packed import batch_of, matrix, numbers, packed, spread
from headcount.session import cut_lineage

#: Bins of a feature at most: a bin fits a byte.
MAX_BINS = 128
#: Sums of one kind that a task holds; nodes beyond wait for the next scan.
HELD_SUMS = 2_000_000
#: Sums of all tasks of a scan that the driver takes to choose splits itself; beyond, Spark
#: adds them up and tasks choose.
DRIVER_SUMS = 400_000
#: Boosting rounds after which the margins are stored again.
ROUNDS_HELD = 10
#: Gains that differ by less are ties, which go to the first feature and cut.
TIE = 1e-9


@dataclass(frozen=True)
class Growth:
    """How one tree grows.

    `features` is the share of features looked at for each split, all if None; with
    `random_cuts` each of them is cut at one random place. `leaves` grows the best leaf
    first, up to that many. Criteria are gini, entropy and newton (gradients and
    curvatures); `l2` and `min_weight` (curvature of a side) are for the last.
    """

    criterion: str = "gini"
    max_depth: int = 30
    min_split: float = 2
    min_leaf: float = 1
    features: float | None = None
    random_cuts: bool = False
    leaves: int | None = None
    l2: float = 1.0
    min_weight: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Sample:
    """The rows and features that a tree sees: all but a fold, a share of each by hash."""

    holdout: int = -1
    rows: float = 1.0
    features: float = 1.0


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Values are shares of class 1, or margins."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])

    def add(self, value: float, level: int) -> int:
        for column, v in zip(
            (self.feature, self.cut, self.left, self.value, self.gain, self.level),
            (-1, 0, 0, value, 0.0, level),
            strict=True,
        ):
            column.append(v)
        return len(self.feature) - 1

    @property
    def depth(self) -> int:
        """Levels below the root, of leaves that can be reached."""
        deepest, waiting = 0, [0]
        while waiting:
            node = waiting.pop()
            deepest = max(deepest, self.level[node])
            if self.feature[node] >= 0:
                waiting += [self.left[node], self.left[node] + 1]
        return deepest

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row comes to."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), dtype=np.int64)
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            here = at[moving]
            at[moving] = left[here] + (bins[moving, feature[here]] > cut[here])
            moving = moving[feature[at[moving]] >= 0]
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def best_first(self, leaves: int) -> set[int]:
        """The splits made when the leaf with the largest gain always comes first."""
        chosen: set[int] = set()
        waiting = [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
        while waiting and len(chosen) < leaves - 1:
            _, node = heapq.heappop(waiting)
            chosen.add(node)
            for child in (self.left[node], self.left[node] + 1):
                if self.feature[child] >= 0:
                    heapq.heappush(waiting, (-self.gain[child], child))
        return chosen


def hashed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in 0..1 for each id, by the published splitmix64 finaliser."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


# --- bins -------------------------------------------------------------------


def cuts_of(df: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the rising values that end a bin, from one mergeable quantile summary.

    A feature of fewer values than bins has each of its values, unless it is rarer than
    a bin; the largest ends no bin.
    """
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 20 * bins).alias(f"q{i}") for i, c in enumerate(features)],
        *[F.max(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
    ).first()
    out = []
    for i in range(len(features)):
        values = np.unique(np.array(found[f"q{i}"] or [], dtype=float))
        out.append(values[values < found[f"m{i}"]] if len(values) else values)
    return out


def _to_bins(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(rows.shape, dtype=np.uint8)
    for i, own in enumerate(cuts):
        out[:, i] = np.searchsorted(own, rows[:, i], side="left")
    return out


def binned(
    df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], fold: str | None = None, merged: bool = False
) -> DataFrame:
    """(id, bins, y, fold, n): the stored table that trees grow on; null labels are left out.

    With `merged`, rows of the same bins, label and fold are one row with their number in
    `n`, so there are no more rows than ways to combine bins; trees that see a share of the
    rows need them apart.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
                at = batch.schema.get_field_index("x")
                yield batch.set_column(at, "bins", packed(_to_bins(rows, cuts)))

    rows = df.where(F.col(f"`{label}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("id"),
        F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]).alias("x"),
        F.col(f"`{label}`").cast("double").alias("y"),
        (F.lit(-2) if fold is None else F.col(fold)).cast("int").alias("fold"),
    )
    made = rows.mapInArrow(pack, "id long, bins binary, y double, fold int")
    if merged:
        same = made.groupBy("bins", "y", "fold").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        made = same.select("id", "bins", "y", "fold", "n")
    else:
        made = made.withColumn("n", F.lit(1).cast("long"))
    made = cut_lineage(made)
    # every scan reads these files, so they are as many as tasks can run
    return cut_lineage(spread(made, made.count(), "id"))


@dataclass
class Rows:
    """Some rows of a stored table, each `n` times: `bins` is a matrix, and so are `margins` if it has them."""

    id: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    margins: np.ndarray | None = None


def _read(batch: pa.RecordBatch, width: int, models: int = 0) -> Rows:
    bins = matrix(batch.column("bins"), width, np.uint8)
    margins = matrix(batch.column("margins"), models, np.float64) if models else None
    return Rows(numbers(batch, "id"), bins, numbers(batch, "y"), numbers(batch, "fold"), numbers(batch, "n"), margins)


# --- growth -----------------------------------------------------------------

_SUMS = "tree int, node int, feature int, bin int, a double, b double, n double"
_SUM_TYPES = dict.fromkeys(("tree", "node", "feature", "bin"), pa.int32()) | dict.fromkeys("abn", pa.float64())
_CHOSEN = (
    "tree int, node int, a double, b double, n double, feature int, cut int, gain double,"
    " left_a double, left_b double, left_n double"
)


def looked_at(growth: Growth, sample: Sample, node: int, width: int) -> np.ndarray:
    """The features that a node's split may use: those of the tree, or a draw of them.

    Draws follow from the seed of the growth, whatever trees grow beside.
    """
    own = np.arange(width)
    if sample.features < 1:
        draw = np.random.default_rng([growth.seed])
        own = np.sort(draw.choice(width, max(1, int(sample.features * width)), replace=False))
    if growth.features is None:
        return own
    draw = np.random.default_rng([growth.seed, node])
    return np.sort(draw.choice(own, max(1, min(len(own), int(growth.features * width))), replace=False))


def _counting(
    trees: dict[int, Tree],
    open_: dict[int, list[int]],
    growths: dict[int, Growth],
    samples: dict[int, Sample],
    parts: Callable[[Rows], Callable[[int], tuple[np.ndarray, np.ndarray]]],
    width: int,
    bins: int,
    margins: int = 0,
) -> Callable:
    """Adds up the rows of a task by (tree, node, feature, bin)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = {t: [looked_at(growths[t], samples[t], n, width) for n in nodes] for t, nodes in open_.items()}
        most = {t: max(map(len, own)) for t, own in looked.items()}
        # a shorter list repeats its first feature, which is not read again
        chosen = {t: np.array([np.resize(f, most[t]) for f in own]) for t, own in looked.items()}
        sums = {t: np.zeros((3, len(nodes) * most[t] * bins)) for t, nodes in open_.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            read = _read(batch, width, margins)
            rows, fold, of = read.bins, read.fold, parts(read)
            for t, nodes in open_.items():
                place = np.full(len(trees[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[trees[t].nodes(rows)]
                used = (at >= 0) & (fold != samples[t].holdout)
                if samples[t].rows < 1:
                    used &= hashed(read.id, growths[t].seed) < samples[t].rows
                which = np.flatnonzero(used)
                if not len(which):
                    continue
                a, b = of(t)
                here, m, n = at[which], most[t], read.n[which].astype(float)
                a, b = a[which] * n, b[which] * n
                for j in range(m):
                    cell = (here * m + j) * bins + rows[which, chosen[t][here, j]]
                    for k, weight in enumerate((a, b, n)):
                        sums[t][k] += np.bincount(cell, weight, minlength=sums[t].shape[1])
        for t, nodes in open_.items():
            cells = np.flatnonzero(sums[t][2])
            slot, bin_ = cells // bins, cells % bins
            node, j = slot // most[t], slot % most[t]
            own = j < np.array([len(f) for f in looked[t]])[node]
            cells, bin_, node, j = cells[own], bin_[own], node[own], j[own]
            yield batch_of(
                {
                    "tree": np.full(len(node), t),
                    "node": np.array(nodes)[node],
                    "feature": chosen[t][node, j],
                    "bin": bin_,
                    "a": sums[t][0][cells],
                    "b": sums[t][1][cells],
                    "n": sums[t][2][cells],
                },
                _SUM_TYPES,
            )

    return count


def _worth(growth: Growth, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the sums of a node are worth; a split gains what its sides are worth more."""
    if growth.criterion == "newton":
        return a * a / (b + growth.l2 + 1e-300) / 2
    share = b / np.maximum(n, 1e-300)
    if growth.criterion == "gini":
        return -2 * n * share * (1 - share)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where((share > 0) & (share < 1), share * np.log2(share) + (1 - share) * np.log2(1 - share), 0.0)
    return n * inner


def _choosing(growths: dict[int, Growth]) -> Callable:
    """The best split of one node from its sums by feature and bin."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iat[0]), int(group["node"].iat[0])
        growth = growths[tree]
        group = group.sort_values(["feature", "bin"])
        first = group[group["feature"] == group["feature"].iat[0]]
        whole = first[["a", "b", "n"]].to_numpy().sum(axis=0)
        best = (-1, 0, 0.0, 0.0, 0.0, 0.0)
        base = float(_worth(growth, *whole[:, None])[0])
        for feature, part in group.groupby("feature", sort=True):
            bins = part["bin"].to_numpy()
            left = part[["a", "b", "n"]].to_numpy().cumsum(axis=0)[:-1].T
            if not left.shape[1]:
                continue
            if growth.random_cuts:
                u = np.random.default_rng([growth.seed, node, int(feature)]).random()
                at = int(np.searchsorted(bins, bins[0] + int(u * (bins[-1] - bins[0])), side="right")) - 1
                left, cuts = left[:, at : at + 1], bins[at : at + 1]
            else:
                cuts = bins[:-1]
            right = whole[:, None] - left
            gain = _worth(growth, *left) + _worth(growth, *right) - base
            fits = (left[2] >= growth.min_leaf) & (right[2] >= growth.min_leaf)
            if growth.criterion == "newton":
                fits &= (left[1] >= growth.min_weight) & (right[1] >= growth.min_weight)
            gain = np.where(fits, gain, -np.inf)
            at = int(np.argmax(gain >= gain.max() - TIE * max(1.0, abs(base))))
            if gain[at] > best[2] + TIE * max(1.0, abs(base)):
                best = (int(feature), int(cuts[at]), float(gain[at]), *map(float, left[:, at]))
        return pd.DataFrame([(tree, node, *map(float, whole), *best)], columns=[c.split()[0] for c in _CHOSEN.split(", ")])

    return choose


def _value(growth: Growth, a: float, b: float, n: float) -> float:
    if growth.criterion == "newton":
        return -a / (b + growth.l2 + 1e-300)
    return b / n if n else 0.0


def _may_split(growth: Growth, level: int, a: float, b: float, n: float) -> bool:
    pure = growth.criterion != "newton" and (a <= 0 or b <= 0)
    return level < growth.max_depth and n >= growth.min_split and n >= 2 * growth.min_leaf and not pure


def grow(
    table: DataFrame,
    growths: dict[int, Growth],
    samples: dict[int, Sample],
    parts: Callable,
    width: int,
    bins: int,
    margins: int = 0,
) -> dict[int, Tree]:
    """One tree for each entry of `growths`, all in the same scans of `table`.

    `parts` says what a row adds to the two sums of a tree; the table has so many
    `margins`. There is one scan per level,
    and more only where the sums of a level exceed `HELD_SUMS`.
    """
    trees = {t: Tree() for t in growths}
    tasks = table.sparkSession.sparkContext.defaultParallelism
    waiting = [(t, 0) for t in growths]
    while waiting:
        open_: dict[int, list[int]] = {}
        held, rest = 0, []
        for t, node in waiting:
            more = bins * max(1, int((growths[t].features or 1.0) * width))
            if open_ and held + more > HELD_SUMS:
                rest.append((t, node))
            else:
                held += more
                open_.setdefault(t, []).append(node)
        counted = table.mapInArrow(_counting(trees, open_, growths, samples, parts, width, bins, margins), _SUMS)
        keys = ["tree", "node", "feature", "bin"]
        choose = _choosing(growths)
        if held <= DRIVER_SUMS // max(1, tasks):
            # the tasks' sums are few: the driver adds them up, without a shuffle
            met = counted.toArrow().to_pandas().groupby(keys, as_index=False)[["a", "b", "n"]].sum()
            chosen = [choose(own) for _, own in met.groupby(["tree", "node"])]
        else:
            sums = counted.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
            chosen = [sums.groupBy("tree", "node").applyInPandas(choose, _CHOSEN).toPandas()]
        rows = pd.concat(chosen).sort_values(["tree", "node"]).to_dict("records") if chosen else []
        grown = []
        for row in rows:
            t, node = row["tree"], row["node"]
            tree, growth = trees[t], growths[t]
            whole = (row["a"], row["b"], row["n"])
            if not node:
                tree.value[0] = _value(growth, *whole)
            if row["feature"] < 0 or not _may_split(growth, tree.level[node], *whole):
                continue
            tree.feature[node], tree.cut[node], tree.gain[node] = row["feature"], row["cut"], row["gain"]
            low = (row["left_a"], row["left_b"], row["left_n"])
            sides = (low, tuple(w - v for w, v in zip(whole, low, strict=True)))
            level = tree.level[node] + 1
            for side in sides:
                child = tree.add(_value(growth, *side), level)
                if side is sides[0]:
                    tree.left[node] = child
                if _may_split(growth, level, *side):
                    grown.append((t, child))
        waiting = rest + _still_wanted(trees, growths, grown)
    for t, tree in trees.items():
        if growths[t].leaves:
            kept = tree.best_first(growths[t].leaves)
            tree.feature = [f if i in kept else -1 for i, f in enumerate(tree.feature)]
    return trees


def _still_wanted(trees: dict[int, Tree], growths: dict[int, Growth], grown: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the leaves below splits that the best leaves of their tree come before.

    Splits found later can only come in between, so a split beyond the number of leaves
    by what is known now is beyond it in the end: the tree is the one grown leaf by leaf.
    """
    kept = {t: trees[t].best_first(g.leaves) for t, g in growths.items() if g.leaves}
    above = {
        t: {child: i for i, f in enumerate(trees[t].feature) if f >= 0 for child in (trees[t].left[i], trees[t].left[i] + 1)}
        for t in kept
    }
    return [(t, node) for t, node in grown if t not in kept or above[t][node] in kept[t]]


# --- models -----------------------------------------------------------------


def _by_class(rows: Rows) -> Callable:
    one = rows.y == 1
    both = ((~one).astype(float), one.astype(float))
    return lambda tree: both


def classify(table: DataFrame, growths: dict[int, Growth], samples: dict[int, Sample], width: int, bins: int) -> dict[int, Tree]:
    """Classification trees, all at once; their leaves hold the share of class 1."""
    return grow(table, growths, samples, _by_class, width, bins)


@dataclass(frozen=True)
class Boost:
    """A boosted model: rounds of newton trees, each fitted to the margins so far.

    `average` starts from the log odds of class 1 in place of even odds.
    """

    rounds: int = 100
    rate: float = 0.3
    growth: Growth = Growth(criterion="newton", max_depth=6, min_weight=1.0)
    sample: Sample = Sample()
    average: bool = False


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(margin / 2))


def boost(table: DataFrame, models: dict[int, Boost], width: int, bins: int) -> dict[int, tuple[float, list[Tree]]]:
    """(start, trees) of each model; all models grow a tree of a round in the same scans.

    Margins are stored with the rows every `ROUNDS_HELD` rounds, so a scan walks few trees.
    """
    counts = table.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("ones")).collect()
    start = {}
    for m, model in models.items():
        own = [r for r in counts if r["fold"] != model.sample.holdout]
        n, ones = sum(r["n"] for r in own), sum(r["ones"] for r in own)
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        start[m] = math.log(share / (1 - share)) if model.average else 0.0
    order = sorted(models)
    place = {m: i for i, m in enumerate(order)}
    first = F.lit(np.array([start[m] for m in order]).tobytes())
    state = cut_lineage(table.withColumn("margins", first))
    trees: dict[int, list[Tree]] = {m: [] for m in order}
    recent: dict[int, list[Tree]] = {m: [] for m in order}

    def margins(rows: Rows) -> np.ndarray:
        out = rows.margins.copy()
        for m, own in recent.items():
            for tree in own:
                out[:, place[m]] += models[m].rate * tree.values(rows.bins)
        return out

    def slopes(rows: Rows) -> Callable:
        chance = _sigmoid(margins(rows))

        def of(m: int) -> tuple[np.ndarray, np.ndarray]:
            own = chance[:, place[m]]
            return own - rows.y, own * (1 - own)

        return of

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("margins")
                yield batch.set_column(at, "margins", packed(margins(_read(batch, width, len(order)))))

    for turn in range(max((m.rounds for m in models.values()), default=0)):
        now = [m for m in order if turn < models[m].rounds]
        growths = {m: _turned(models[m].growth, turn) for m in now}
        grown = grow(state, growths, {m: models[m].sample for m in now}, slopes, width, bins, len(order))
        for m in now:
            trees[m].append(grown[m])
            recent[m].append(grown[m])
        if (turn + 1) % ROUNDS_HELD == 0:
            state = cut_lineage(state.mapInArrow(store, state.schema))
            recent = {m: [] for m in order}
    return {m: (start[m], trees[m]) for m in order}


def _turned(growth: Growth, turn: int) -> Growth:
    """The growth of a round: its draws are its own."""
    return Growth(**{**growth.__dict__, "seed": growth.seed + 104_729 * turn})


@dataclass
class GrownModel:
    """Cut points and trees; `rate` is null for one classification tree.

    Serves where a fitted Spark model does: `transform` adds probability and prediction.
    """

    cuts: list[np.ndarray]
    trees: list[Tree]
    start: float = 0.0
    rate: float | None = None

    @property
    def depth(self) -> int:
        return max(t.depth for t in self.trees)

    def chance(self, bins: np.ndarray) -> np.ndarray:
        """The probability of class 1 for binned rows."""
        if self.rate is None:
            return self.trees[0].values(bins)
        return _sigmoid(self.start + self.rate * sum(t.values(bins) for t in self.trees))

    def transform(self, df: DataFrame, vector: str = "features_vector") -> DataFrame:
        @F.pandas_udf("double")
        def chance(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            values = np.array(rows.tolist(), dtype=float).reshape(len(rows), -1)
            return pd.Series(self.chance(_to_bins(np.nan_to_num(values), self.cuts)))

        one = F.col("_chance")
        return (
            df.withColumn("_chance", chance(vector_to_array(vector)))
            .withColumn("probability", array_to_vector(F.array(1 - one, one)))
            .withColumn("prediction", (one > 0.5).cast("double"))
            .drop("_chance")
        )


def confusion(table: DataFrame, models: dict[int, tuple[int, GrownModel]], width: int) -> DataFrame:
    """(model, hit, false, missed, rows): counts on the rows of each model's holdout fold.

    All models, given as (holdout, model), are scored in one scan.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 4), dtype=np.int64)
        for batch in batches:
            read = _read(batch, width)
            rows, fold, y = read.bins, read.fold, read.y == 1
            for i, (holdout, model) in enumerate(models.values()):
                own = fold == holdout
                if own.any():
                    said, true, n = model.chance(rows[own]) > 0.5, y[own], read.n[own]
                    total[i] += [n[said & true].sum(), n[said & ~true].sum(), n[~said & true].sum(), n.sum()]
        found = dict(zip(("model", "hit", "false", "missed", "rows"), (list(models), *total.T), strict=True))
        yield batch_of(found, {n: pa.int32() if n == "model" else pa.int64() for n in found})

    return (
        table.mapInArrow(count, "model int, hit long, false long, missed long, rows long")
        .groupBy("model")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "false", "missed", "rows")])
    )
