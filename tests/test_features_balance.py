import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headcount.operators import balance, features, neighbours, space
from headcount.operators.columns import align_columns


def test_one_hot_drops_the_first_and_names_null(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "s string, k int")
    plan = features.fit_features(df, ["s"], [])
    assert plan.outputs == ["s_b", "s_nan"]
    got = {r["k"]: (r["s_b"], r["s_nan"]) for r in plan.one_hot(df).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 1.0)}
    unseen = spark.createDataFrame([("zebra", 1)], "s string, k int")
    assert tuple(plan.one_hot(unseen).first()) == (1, 0.0, 0.0)


def test_too_many_categories(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="more than 10 categories"):
        features.category_values(df, ["s"], 10)


def test_scale_by_the_training_range(spark):
    df = spark.createDataFrame([(1.0, 7), (3.0, 7), (None, 7)], "x double, same int")
    plan = features.fit_features(df, [], ["x", "same"])
    assert [tuple(r) for r in plan.scale(df).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    outside = spark.createDataFrame([(5.0, 8)], "x double, same int")
    assert tuple(plan.scale(outside).first()) == (2.0, 1.0)


def test_batch_is_prepared_like_training(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "s string, x double")
    plan = features.fit_features(df, ["s"], ["x"])
    batch = spark.createDataFrame([(None, 3.0), ("c", 1.0), ("b", 5.0)], "s string, x double")
    got = [tuple(r) for r in plan.prepare_batch(batch).collect()]
    # The missing category takes the training mode.
    assert plan.outputs == ["x", "s_b"] and got == [(0.5, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_align(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert align_columns(df, ["c", "new", "a"]).first().asDict() == {"c": 3, "new": 0.0, "a": 1}


def test_target(spark):
    df = spark.createDataFrame([("Yes", 3), ("No", 0), ("maybe", 1)], "t string, n int")
    assert [r["label"] for r in features.with_target(df, "t").collect()] == [1.0, 0.0, None]
    assert [r["label"] for r in features.with_target(df, "n").collect()] == [3.0, 0.0, 1.0]


@pytest.mark.parametrize("rows,pct,want", [(101, 20, 21), (100, 50, 50), (7, 10, 1)])
def test_split_size_rounds_up_and_is_stable(spark, rows, pct, want):
    df = spark.range(rows)
    first = {r["id"] for r in features.train_test_split(df, "id", pct).where("is_test").collect()}
    again = {r["id"] for r in features.train_test_split(df.repartition(5), "id", pct).where("is_test").collect()}
    assert len(first) == want and first == again


def test_split_share_is_limited(spark):
    with pytest.raises(ValueError):
        features.train_test_split(spark.range(5), "id", 5)


@pytest.mark.parametrize(
    "share,scenario,strategy",
    [
        (99, "Extremely imbalanced", "smote_enn"),
        (95, "Highly imbalanced", "smote_enn"),
        (80, "Getting imbalanced", "smote"),
        (60, "Still manageable", "random_undersample"),
        (55, "Ideal balance", "none"),
    ],
)
def test_scenarios_at_their_limits(spark, share, scenario, strategy):
    df = spark.range(100).select((F.col("id") >= share).cast("int").alias("y"))
    row = balance.class_balance(df, "y").first()
    assert (row["scenario"], row["strategy"]) == (scenario, strategy)
    assert row["class_ratio"] == f"{share}.0% : {100 - share}.0%"


def test_one_class_is_reported(spark):
    row = balance.class_balance(spark.range(5).select(F.lit(1).alias("y")), "y").first()
    assert row["advice"].startswith("Only one class") and row["scenario"] is None


def test_undersample_evens_three_classes(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 960, "b").otherwise("c").alias("y"))
    got = {r["y"]: r["count"] for r in balance.random_undersample(df, "y", "id").groupBy("y").count().collect()}
    assert got == {"a": 40, "b": 40, "c": 40}


def _points(seed, n=900, copies=0.34):
    """Random points of two classes; a third of them are copies of one."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 3)), 2)
    x[: int(n * copies)] = 0.5
    return pd.DataFrame(x, columns=["p", "q", "r"]).assign(label=(rng.random(n) < 0.25).astype(float), id=range(n))


def _brute(points, k):
    near = {}
    for p in points:
        squares = np.zeros(len(points))
        for d in range(points.shape[1]):
            squares += (p[d] - points[:, d]) ** 2
        squares[(points == p).all(axis=1)] = np.inf
        near[tuple(p)] = [tuple(points[i]) for i in np.argsort(squares, kind="stable")[:k]]
    return near


@pytest.mark.parametrize("cell_rows,fan_out", [(50, 1024), (100_000, 1024), (4, 8)])
def test_neighbours_equal_brute_force(spark, monkeypatch, cell_rows, fan_out):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(space, "FAN_OUT", fan_out)
    monkeypatch.setattr(space, "DESK_ROWS", 30)
    rng = np.random.default_rng(11)
    # several levels of tiny cells are many small jobs
    some = 1 if cell_rows >= 50 else 3
    cluster = rng.random((250 // some, 3)) * 0.01
    points = np.unique(np.vstack([np.round(rng.random((300 // some, 3)), 1), cluster]), axis=0)
    df = spark.createDataFrame([(p.tolist(), [1]) for p in points], "vec array<double>, sizes array<bigint>")
    found = neighbours.nearest_vectors(df, 5).collect()
    got = {tuple(r["vec"]): [tuple(n["vec"]) for n in r["neighbours"]] for r in found}
    assert len(found) == len(points) and got == _brute(points, 5)


def test_cells_grow_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(space, "FAN_OUT", 4)
    points = np.random.default_rng(4).standard_normal((900, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    cells = space.cells_of(df, 3, 10, seed=1)
    sizes = cells.table.groupBy("cell").count().toPandas()["count"]
    assert len(cells.trees) >= 2 and sizes.max() <= 20 and sizes.sum() == 900


@pytest.mark.parametrize("bucket", [40, 4])
def test_hashed_neighbours_find_most(spark, monkeypatch, bucket):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "TABLES", 12 if bucket == 40 else 1)
    rng = np.random.default_rng(12)
    points = rng.standard_normal((500, 3)) @ rng.standard_normal((3, 9)) + rng.standard_normal((500, 9)) * 0.1
    df = spark.createDataFrame([(p.tolist(), [1]) for p in points], "vec array<double>, sizes array<bigint>")
    found = neighbours.hashed_vectors(df, 5).collect()
    true = _brute(points, 5)
    got = {tuple(r["vec"]): [tuple(n["vec"]) for n in r["neighbours"]] for r in found}
    assert len(got) == 500 and all(len(set(n)) == 5 for n in got.values())
    hits = sum(len(set(got[p]) & set(true[p])) for p in true)
    assert hits >= (0.9 * 2500 if bucket == 40 else 1)
    # rows that met too few in their buckets got the exact ones
    for r in found:
        squares = [n["square"] for n in r["neighbours"]]
        assert squares == sorted(squares) and squares[0] > 0


def test_hashed_method_evens_the_classes(spark):
    frame = _points(1)
    got = balance.smote(spark.createDataFrame(frame), "label", ["p", "q", "r"], method="hashed").toPandas()
    assert (got["label"] == 0).sum() == (got["label"] == 1).sum()
    kept = balance.smote_enn(spark.createDataFrame(frame), "label", ["p", "q", "r"], method="hashed").toPandas()
    assert 0 < len(kept) <= len(got)


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([([0.0], [1]), ([1.0], [1])], "vec array<double>, sizes array<bigint>")
    got = {r["vec"][0]: [n["vec"][0] for n in r["neighbours"]] for r in neighbours.nearest_vectors(df, 5).collect()}
    assert got == {0.0: [1.0], 1.0: [0.0]}


def test_smote_evens_the_classes_within_the_minority_box(spark, monkeypatch):
    monkeypatch.setattr(balance, "CHUNK", 7)
    frame = _points(1)
    df = spark.createDataFrame(frame)
    got = balance.smote(df, "label", ["p", "q", "r"]).toPandas()
    sizes = got["label"].value_counts()
    assert sizes[0.0] == sizes[1.0] == (frame["label"] == 0).sum()
    assert (~got["synthetic"]).sum() == len(frame)
    made, minority = got[got["synthetic"]], frame[frame["label"] == 1]
    for c in ("p", "q", "r"):
        assert made[c].between(minority[c].min(), minority[c].max()).all()
    again = balance.smote(df.repartition(7), "label", ["p", "q", "r"]).toPandas()
    order = ["synthetic", "p", "q", "r", "label"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))


def test_made_rows_lie_between_a_row_and_its_neighbour(spark):
    frame = _points(2, 200, 0.0)
    minority = frame[frame["label"] == 1][["p", "q", "r"]].drop_duplicates().to_numpy()
    near = _brute(np.array(sorted(map(tuple, minority))), 5)
    made = balance.smote(spark.createDataFrame(frame), "label", ["p", "q", "r"]).where("synthetic").toPandas()
    segments = [(np.array(a), np.array(b)) for a, bs in near.items() for b in [a, *bs]]
    for row in made[["p", "q", "r"]].to_numpy():
        gaps = [np.linalg.norm(a - row) + np.linalg.norm(row - b) - np.linalg.norm(a - b) for a, b in segments]
        assert min(gaps) < 1e-9


def test_smote_needs_enough_rows(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") < 3).cast("double").alias("y"))
    with pytest.raises(ValueError, match="more than 5 are needed"):
        balance.smote(df, "y", ["x"])
    with pytest.raises(ValueError, match="two to 1000 classes"):
        balance.smote(df.withColumn("y", F.lit(1.0)), "y", ["x"])


def test_smote_fills_up_every_class(spark):
    df = spark.range(90).selectExpr("id * 1.0D x", "CASE WHEN id < 50 THEN 0 WHEN id < 80 THEN 1 ELSE 2 END y")
    got = balance.smote(df, "y", ["x"]).groupBy("y", "synthetic").count().collect()
    assert {(r["y"], r["synthetic"]): r["count"] for r in got} == {
        (0, False): 50, (1, False): 30, (1, True): 20, (2, False): 10, (2, True): 40,
    }


def test_a_batch_may_lack_columns_and_numbers(spark):
    train = spark.createDataFrame([(1.0, "a", 5.0), (3.0, "b", 9.0)], "Pay double, Team string, Age double")
    plan = features.fit_features(train, ["Team"], ["Pay", "Age"])
    batch = spark.createDataFrame([(1, None, "b", "x"), (2, 2.0, None, "y")], "id int, PAY double, team string, more string")
    got = plan.prepare_batch(batch, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 0.0)]


def test_edited_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    frame = _points(3, 400)
    df = spark.createDataFrame(frame.drop(columns="id")).withColumn("synthetic", F.lit(False))
    got = balance.edited_nearest(df, "label", ["p", "q", "r"]).toPandas()
    rows = frame[["p", "q", "r", "label"]].to_numpy()
    kept = []
    for i, row in enumerate(rows):
        squares = np.zeros(len(rows))
        for d in range(3):
            squares += (row[d] - rows[:, d]) ** 2
        others = [j for j in range(len(rows)) if j != i]
        others.sort(key=lambda j: (squares[j], *rows[j, :3], rows[j, 3]))
        if all(rows[j, 3] == row[3] for j in others[:3]):
            kept.append(tuple(row))
    assert sorted(map(tuple, got[["p", "q", "r", "label"]].to_numpy())) == sorted(kept)


def test_most_vectors_end_at_home(spark, monkeypatch):
    draw = np.random.default_rng(8)
    points = draw.random((3000, 2))
    rows = spark.createDataFrame([(p.tolist(), [1]) for p in points], "vec array<double>, sizes array<bigint>")
    monkeypatch.setattr(neighbours, "CELL_ROWS", 200)
    asked, visits = [], space.visits
    monkeypatch.setattr(space, "visits", lambda a, *rest: asked.append(a.count()) or visits(a, *rest))
    got = {tuple(r["vec"]): [tuple(n["vec"]) for n in r["neighbours"]] for r in neighbours.nearest_vectors(rows, 3).collect()}
    assert sum(asked) < 3000
    for p in points[::50]:
        near = np.argsort(((points - p) ** 2).sum(axis=1), kind="stable")[1:4]
        assert got[tuple(p)] == [tuple(q) for q in points[near].tolist()]


def test_hashed_tables_are_cut_in_common_jobs(spark):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, draw.random(3).tolist()) for i in range(2000)], "id long, vec array<double>")
    together = space.buckets_of(rows, 3, 100, [7, 1007]).collect()
    for table, seed in enumerate((7, 1007)):
        alone = {r["id"]: r["cell"] for r in space.cells_of(rows, 3, 100, seed, slanted=True).table.collect()}
        assert {r["id"]: r["cell"].split(":")[1] for r in together if r["cell"].startswith(f"{table}:")} == alone


def test_cells_are_cut_between_values():
    """A vector on either side of a cut is half a step from it, so a small ball stays in its cell."""
    places = np.array([(x, y, z / 4) for x in range(2) for y in range(2) for z in range(5)], dtype=float)
    cells = space.grow(places, 6)
    who, at, _ = cells.reached(places, np.full(len(places), 0.01))
    assert who.tolist() != [] and sorted(who) == list(range(len(places)))
    assert len(set(at)) == 6 and dict(zip(who, at, strict=True)) == dict(enumerate(cells.cell(places)))


def test_vectors_near_few_cells_visit_them_in_one_round(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    rounds = []
    seen = space.visits
    monkeypatch.setattr(neighbours.space, "visits", lambda *a: rounds.append(1) or seen(*a))
    draw = np.random.default_rng(5)
    points = sorted({(float(x), float(y)) for x, y in zip(draw.random(500).round(3), draw.integers(0, 4, 500))})
    frame = spark.createDataFrame([(list(p), [1]) for p in points], "vec array<double>, sizes array<bigint>")
    found = {tuple(r["vec"]): [tuple(n["vec"]) for n in r["neighbours"]] for r in neighbours.nearest_vectors(frame, 3).collect()}
    whole = np.array(points)
    for p in points:
        squares = ((whole - p) ** 2).sum(axis=1)
        near = sorted((s, q) for s, q in zip(squares, points) if q != p)[:3]
        assert found[p] == [q for _, q in near]
    assert len(found) == len(points) and len(rounds) == 1
