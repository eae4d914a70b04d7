"""Trees and boosting on binned counts against plain versions that look at every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headcount.operators import trees
from headcount.operators.trees import Boost, Growth, Sample


def rows(n=200, seed=3):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.integers(0, 9, n), np.round(draw.random(n), 1), draw.integers(0, 2, n)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.6) | (draw.random(n) < 0.1)).astype(float)
    return x, y


@pytest.fixture(scope="module")
def stored(spark):
    x, y = rows()
    frame = spark.createDataFrame([(*map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "p double, q double, r double, y double, fold int")
    cuts = trees.cuts_of(frame, ["p", "q", "r"])
    return cuts, trees.binned(frame.repartition(3), ["p", "q", "r"], "y", cuts, "fold"), x, y


def plain_tree(x, stats, worth, value, growth, level=0):
    """(feature, cut value, left, right) or a leaf value; `stats` has a row of sums per row."""
    whole = stats.sum(axis=0)
    leaf = value(*whole)
    if level >= growth.max_depth or len(x) < growth.min_split or len(x) < 2 * growth.min_leaf:
        return leaf
    best = (1e-9 * max(1, abs(worth(*whole))), None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            a, b = stats[low].sum(axis=0), stats[~low].sum(axis=0)
            if min(a[2], b[2]) < growth.min_leaf or (growth.criterion == "newton" and min(a[1], b[1]) < growth.min_weight):
                continue
            gain = worth(*a) + worth(*b) - worth(*whole)
            if gain > best[0] + 1e-9 * max(1, abs(worth(*whole))):
                best = (gain, (f, cut, low))
    if best[1] is None:
        return leaf
    f, cut, low = best[1]
    return f, cut, *[plain_tree(x[s], stats[s], worth, value, growth, level + 1) for s in (low, ~low)]


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def gini(a, b, n):
    return -2 * n * (b / n) * (1 - b / n)


def entropy(a, b, n):
    return n * sum(p * math.log2(p) for p in (b / n, 1 - b / n) if 0 < p)


def newton(a, b, n):
    return a * a / (b + 1.0) / 2


@pytest.mark.parametrize(
    "growth,worth",
    [(Growth(max_depth=4), gini), (Growth(max_depth=30), gini), (Growth("entropy", max_depth=5, min_split=20), entropy), (Growth(max_depth=9, min_leaf=7), gini)],
)
def test_tree_equals_plain_version(stored, growth, worth):
    cuts, table, x, y = stored
    own = trees.classify(table, {0: growth}, {0: Sample()}, 3, trees.MAX_BINS)[0]
    stats = np.column_stack([1 - y, y, np.ones(len(y))])
    plain = plain_tree(x, stats, worth, lambda a, b, n: b / n, growth)
    got = own.values(trees._to_bins(x, cuts))
    assert np.abs(got - [plain_value(plain, r) for r in x]).max() < 1e-12


def test_many_trees_in_the_scans_of_the_deepest(stored, monkeypatch):
    _, table, x, _ = stored
    growths = {i: Growth(max_depth=1 + i % 5, min_leaf=1 + i % 3, criterion=("gini", "entropy")[i % 2]) for i in range(12)}
    samples = {i: Sample(holdout=i % 4 - 1) for i in growths}
    scans = []
    counting = trees._counting
    monkeypatch.setattr(trees, "_counting", lambda *a: scans.append(1) or counting(*a))
    together = trees.classify(table, growths, samples, 3, trees.MAX_BINS)
    assert len(scans) <= 5
    monkeypatch.setattr(trees, "HELD_SUMS", 500)
    for i in (0, 7, 11):
        assert trees.classify(table, {i: growths[i]}, samples, 3, trees.MAX_BINS)[i] == together[i]


def test_settings_are_honoured(stored):
    cuts, table, x, y = stored
    bins = trees._to_bins(x, cuts)
    growths = {
        0: Growth(min_split=60),
        1: Growth(min_leaf=25),
        2: Growth(features=0.34, seed=1),
        3: Growth(random_cuts=True, seed=1),
        4: Growth(random_cuts=True, seed=2),
        5: Growth(max_depth=2),
        6: Growth(leaves=6),
    }
    made = trees.classify(table, growths, {i: Sample() for i in growths}, 3, trees.MAX_BINS)
    sizes = {i: np.bincount(t.nodes(bins), minlength=len(t.feature)) for i, t in made.items()}
    assert sizes[1][sizes[1] > 0].min() >= 25 and made[5].depth == 2
    parents = [n for n, f in enumerate(made[0].feature) if f >= 0]
    below = {n: (made[0].nodes(bins) == n).sum() for n in range(len(made[0].feature))}
    for n in reversed(parents):
        below[n] = below[made[0].left[n]] + below[made[0].left[n] + 1]
    assert min(below[n] for n in parents) >= 60
    assert made[3].cut != made[4].cut and len(set(made[2].feature)) > 2
    for n, f in enumerate(made[2].feature):
        assert f < 0 or f in trees.looked_at(growths[2], Sample(), n, 3)
    assert len(np.unique(made[6].nodes(bins))) == 6


def test_best_leaf_first_equals_one_leaf_at_a_time(stored):
    """The leaves found level by level are those of growth by the largest gain."""
    cuts, table, x, y = stored
    whole = trees.classify(table, {0: Growth(max_depth=12)}, {0: Sample()}, 3, trees.MAX_BINS)[0]
    for leaves in (2, 3, 5, 9):
        own = trees.classify(table, {0: Growth(max_depth=12, leaves=leaves)}, {0: Sample()}, 3, trees.MAX_BINS)[0]
        kept = whole.best_first(leaves)
        whole_cut = trees.Tree(**{**whole.__dict__, "feature": [f if i in kept else -1 for i, f in enumerate(whole.feature)]})
        bins = trees._to_bins(x, cuts)
        assert np.array_equal(own.values(bins), whole_cut.values(bins))


@pytest.mark.parametrize("average", [False, True])
def test_boosting_equals_plain_version(stored, monkeypatch, average):
    monkeypatch.setattr(trees, "ROUNDS_HELD", 2)
    cuts, table, x, y = stored
    growth = Growth("newton", max_depth=3, min_weight=1.0)
    start, made = trees.boost(table, {4: Boost(5, 0.3, growth, average=average)}, 3, trees.MAX_BINS)[4]
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())) if average else 0.0)
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        stats = np.column_stack([p - y, p * (1 - p), np.ones(len(y))])
        plain = plain_tree(x, stats, newton, lambda a, b, n: -a / (b + 1.0), growth)
        margin += 0.3 * np.array([plain_value(plain, r) for r in x])
    model = trees.GrownModel(cuts, made, start, 0.3)
    assert np.abs(model.chance(trees._to_bins(x, cuts)) - 1 / (1 + np.exp(-margin))).max() < 1e-9


def test_boosted_models_together_and_their_holdouts(spark, stored):
    cuts, table, x, y = stored
    level = Boost(4, 0.3, Growth("newton", max_depth=4, min_weight=1.0), Sample(0, rows=0.7, features=0.7))
    leaf = Boost(6, 0.1, Growth("newton", max_depth=6, leaves=5, l2=0.0, min_leaf=10, min_weight=1e-3), Sample(1), True)
    both = trees.boost(table, {0: level, 1: leaf}, 3, trees.MAX_BINS)
    alone = trees.boost(table, {1: leaf}, 3, trees.MAX_BINS)[1]
    bins = trees._to_bins(x, cuts)
    one, other = [trees.GrownModel(cuts, t, s, 0.1).chance(bins) for s, t in (both[1], alone)]
    assert np.abs(one - other).max() < 1e-9 and all(len({*t.nodes(bins)}) <= 5 for t in both[1][1])
    models = {i: (i, trees.GrownModel(cuts, both[i][1], both[i][0], (0.3, 0.1)[i])) for i in both}
    fold = np.arange(len(y)) % 3
    for r in trees.confusion(table, models, 3).collect():
        own = fold == r["model"]
        said = models[r["model"]][1].chance(bins[own]) > 0.5
        assert (r["hit"], r["rows"]) == ((said & (y[own] == 1)).sum(), own.sum())


def test_merged_rows_give_the_same_models(spark):
    """Rows of the same bins, label and fold are one row with a count, and scans see as much."""
    schema = "p double, q double, y double, fold int"
    some = [(i % 3 * 1.0, i % 2 * 1.0, float(i % 3 == 2 or i % 7 == 0), i % 2) for i in range(60)]
    frame = spark.createDataFrame([(x, None if i % 10 == 9 else q, y, f) for _ in range(9) for i, (x, q, y, f) in enumerate(some)], schema)
    cuts = trees.cuts_of(frame, ["p", "q"])
    apart, merged = [trees.binned(frame, ["p", "q"], "y", cuts, "fold", m) for m in (False, True)]
    distinct = {(x, q or 0.0, y, f) for x, q, y, f in frame.collect()}
    assert apart.count() == 540 and merged.count() == len(distinct) < 40
    assert merged.agg(F.sum("n").alias("n")).first()["n"] == 540
    growths = {0: Growth(max_depth=4, min_leaf=20), 1: Growth("entropy", min_split=100, random_cuts=True)}
    for holdout in (-1, 1):
        samples = dict.fromkeys(growths, Sample(holdout))
        assert trees.classify(merged, growths, samples, 2, trees.MAX_BINS) == trees.classify(apart, growths, samples, 2, trees.MAX_BINS)
    boosts = {0: Boost(12, 0.3), 1: Boost(5, 0.1, Growth("newton", max_depth=3, leaves=4, l2=0.0, min_leaf=20, min_weight=1e-3), Sample(0), True)}
    one, other = [trees.boost(t, boosts, 2, trees.MAX_BINS) for t in (merged, apart)]
    bins = trees._to_bins(np.array([(p, q) for p in range(3) for q in range(2)], dtype=float), cuts)
    for m, rate in ((0, 0.3), (1, 0.1)):
        a, b = [trees.GrownModel(cuts, made[m][1], made[m][0], rate) for made in (one, other)]
        assert a.start == b.start and np.abs(a.chance(bins) - b.chance(bins)).max() < 1e-9
        counted = [trees.confusion(t, {m: (0, a)}, 2).collect() for t in (merged, apart)]
        assert counted[0] == counted[1] and counted[0][0]["rows"] == 270


def test_odd_tables(spark):
    schema = "p double, y double"
    for data in ([], [(1.0, None)], [(None, 1.0), (None, 0.0)], [(1.0, 1.0)] * 5):
        frame = spark.createDataFrame(data, schema)
        cuts = trees.cuts_of(frame, ["p"])
        table = trees.binned(frame, ["p"], "y", cuts)
        own = trees.classify(table, {0: Growth()}, {0: Sample()}, 1, trees.MAX_BINS)[0]
        assert own.depth == 0 and own.value[0] == {0: 0.0, 1: 0.0, 2: 0.5, 5: 1.0}[len(data)]
    wide = spark.range(5000).select((F.col("id") * 1.0).alias("p"), (F.col("id") < 2500).cast("double").alias("y"))
    cuts = trees.cuts_of(wide, ["p"])
    assert len(cuts[0]) <= trees.MAX_BINS and np.all(np.diff(cuts[0]) > 0)
