import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from headcount.operators import features, logistic, models, scoring, trees
from headcount.plans import prediction
from suite import learning


@pytest.fixture(scope="module")
def staff(spark):
    """Leaving follows from pay and team, with some noise."""
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    pay = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10
    team = F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int"))
    leaves = (pay < 40) & (team != "c") | (noise < 0.05)
    return (
        spark.range(600)
        .select("id", pay.alias("Pay"), team.alias("Team"), F.when(leaves, "Yes").otherwise("No").alias("Turnover"))
        .cache()
    )


@pytest.fixture(scope="module")
def prepared(staff):
    return prediction.prepare(staff, "Turnover", "id", ["Team"], ["Pay"])


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, h double")
    assert tuple(scoring.classification_metrics(df, "y", "h").first()) == (0.5, 0.0, 0.0, 0.0)


def test_auc_equals_the_evaluator(spark):
    df = spark.range(500).select(
        (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("double").alias("label"),
        (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(20)) / 20).alias("rawPrediction"),
    )
    want = BinaryClassificationEvaluator(numBins=0).evaluate(df)
    assert scoring.roc_auc(df, "label", "rawPrediction").first()[0] == pytest.approx(want)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert scoring.roc_auc(df, "y", "s").first()[0] is None


def test_ranking(spark):
    rows = [("m", 0.9, 0.5, 0.5, 0.5, 0.7), ("n", 0.8, 0.6, 0.6, 0.6, 0.6), ("o", 0.7, 0.6, 0.6, 0.6, 0.5)]
    df = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    got = scoring.rank_models(df).collect()
    assert [r["model"] for r in got] == ["m", "n", "o"]
    assert [r["best"] for r in got] == [False, True, False]


def test_prepared_parts(staff, prepared):
    assert prepared.columns == ["Pay", "Team_b", "Team_c"]
    assert prepared.test.count() == 120
    if prepared.strategy == "random_undersample":
        sizes = {r["label"]: r["count"] for r in prepared.train.groupBy("label").count().collect()}
        assert sizes[0.0] == sizes[1.0]


def test_compare_learns(prepared):
    small = {
        "Decision Tree": {"max_depth": 5},
        "Random Forest": {"n_estimators": 5, "max_depth": 5},
        "xgboost": {"n_estimators": 3, "max_depth": 3},
        "LightGBM": {"n_estimators": 3, "max_depth": 3},
    }
    ranked, fitted = models.train_compare(
        prepared.train, prepared.test, prepared.columns, "label", overrides=small
    )
    rows = ranked.collect()
    assert {r["model"] for r in rows} == set(fitted) == set(models.MODELS)
    assert sum(r["best"] for r in rows) == 1
    tree = next(r for r in rows if r["model"] == "Decision Tree")
    assert tree["accuracy"] > 0.8 and tree["roc_auc"] > 0.8


def test_draws_are_seeded_and_in_range():
    for name in models.MODELS:
        sets = models.draw(name, 20, 7)
        assert sets == models.draw(name, 20, 7) != models.draw(name, 20, 8)
        for p in sets:
            for key, space in models.SPACES[name].items():
                inside = p[key] in space if isinstance(space, list) else space[0] <= p[key] <= space[1]
                assert inside
    for p in models.draw("Logistic Regression", 30):
        assert {"l1": p["l1_ratio"] == 1, "l2": p["l1_ratio"] == 0}.get(p["penalty"], 0 <= p["l1_ratio"] <= 1)


def test_parameters_reach_the_estimator():
    made = models.estimator("Logistic Regression", {"C": 0.5, "max_iter": 200, "l1_ratio": 1.0}, 100)
    assert made.getRegParam() == pytest.approx(1 / 50) and made.getElasticNetParam() == 1.0
    assert models.estimator("Decision Tree", {"criterion": "log_loss"}, 1).getImpurity() == "entropy"
    forest = models.estimator("Random Forest", {}, 1)
    assert (forest.getNumTrees(), forest.getFeatureSubsetStrategy()) == (100, "sqrt")
    with pytest.raises(ValueError, match="no model"):
        models.estimator("Perceptron", {}, 1)


@pytest.mark.parametrize("distinct", [2, 50, 3000])
def test_folds_share_each_class_evenly(spark, distinct):
    rows = spark.range(3000).selectExpr(f"id % {distinct} * 1.0D x", "cast(id % 10 = 0 as double) y")
    got = models.folds(rows, "y", ["x"]).groupBy("label", "fold").count().collect()
    for label, size in ((0.0, 2700), (1.0, 300)):
        counts = [r["count"] for r in got if r["label"] == label]
        assert len(counts) == 3 and sum(counts) == size and max(counts) - min(counts) <= 1


def test_boosted_models_differ_in_growth():
    level = models.growth("xgboost", models.DEFAULTS["xgboost"], 8)
    leaf = models.growth("LightGBM", models.DEFAULTS["LightGBM"], 8)
    assert (level.leaves, level.l2, level.min_leaf) == (None, 1.0, 1) and (leaf.leaves, leaf.l2, leaf.min_leaf) == (31, 0.0, 20)
    tree = models.growth("Decision Tree", models.DEFAULTS["Decision Tree"] | {"max_features": "sqrt", "splitter": "random", "min_samples_split": 9}, 9)
    assert int(tree.features * 9) == 3 and tree.random_cuts and tree.min_split == 9


@pytest.mark.parametrize("name", ["Decision Tree", "LightGBM"])
def test_trials_together_score_as_single_fits(prepared, name):
    """One scan for all trials and folds gives what each fit gives alone."""
    sets = models.draw(name, 2)
    if name == "LightGBM":
        sets = [s | {"n_estimators": 4} for s in sets]
    else:  # random places depend on the bins
        sets = [s | {"splitter": "best", "max_features": None} for s in sets]
    scores = models.cross_validate(prepared.train, prepared.columns, "label", name, sets)
    dealt = models.folds(prepared.train, "label", prepared.columns).toPandas()
    spark = prepared.train.sparkSession
    for params, score in zip(sets, scores, strict=True):
        own = []
        for fold in range(3):
            rest = dealt[dealt["fold"] != fold]
            frame = spark.createDataFrame([(float(y), *map(float, v)) for y, v in zip(rest["label"], rest["vec"])], ["label", *prepared.columns])
            model = models.train(frame, prepared.columns, "label", name, params)
            held = dealt[dealt["fold"] == fold]
            x = np.array(held["vec"].tolist())
            said = model.chance(trees._to_bins(x, model.cuts)) > 0.5
            y = held["label"].to_numpy() == 1
            own.append(2 * (said & y).sum() / max(1, 2 * (said & y).sum() + (said != y).sum()))
        # bins of all rows and of two folds may differ a little
        assert abs(score - sum(own) / 3) < 0.05


def test_few_distinct_rows_can_be_tuned(spark):
    rows = spark.range(300).selectExpr("id % 2 * 1.0D x", "cast(id % 2 as double) y")
    tuned = models.tune(rows, ["x"], "y", "Decision Tree", trials=2)
    assert tuned.score == 1.0


def test_an_undefined_score_loses():
    assert models.best_trial([float("nan"), 0.2, 0.4, 0.4]) == 2
    assert models.best_trial([float("nan"), 0.0]) == 1


@pytest.mark.parametrize("name", ["Decision Tree", "Logistic Regression"])
def test_tune_refits_the_winner(prepared, name):
    tuned = models.tune(prepared.train, prepared.columns, "label", name, trials=3)
    rows = tuned.trials.collect()
    assert len(rows) == 3 and sum(r["best"] for r in rows) == 1
    assert tuned.score == max(r["f1"] for r in rows)
    assert tuned.params in models.draw(name, 3)


def test_scores_of_a_batch_and_of_one_record(spark, staff, prepared):
    model = models.train(prepared.train, prepared.columns, "label", "Decision Tree", {"max_depth": 5})
    batch = staff.drop("Turnover")
    scored = models.score_batch(prepared.plan, model, batch, prepared.columns)
    assert scored.columns == [*batch.columns, "Predicted Turnover", "Probability"]
    assert scored.count() == 600
    wrong = scored.where((F.col("Predicted Turnover") == "Yes") != (F.col("Probability") > 0.5)).count()
    assert wrong == 0
    one = spark.createDataFrame([(1, 5.0, None), (2, 99.0, "unseen")], "id bigint, Pay double, Team string")
    got = models.score_batch(prepared.plan, model, one, prepared.columns).orderBy("id").collect()
    assert [r["Predicted Turnover"] for r in got] == ["Yes", "No"]


def test_refit_uses_the_tuned_parameters(prepared):
    tuned = models.Tuned("Decision Tree", {"max_depth": 1}, 0.0, None, None)
    assert models.fit_best(prepared.train, prepared.columns, "label", tuned).depth == 1
    assert features.FeaturePlan().outputs == []


def test_tune_query_gives_the_figures_of_every_trial(spark, prepared, monkeypatch):
    monkeypatch.setattr(learning, "learnable", lambda spark, d: prepared)
    got = sorted(learning.QUERIES["tune"](spark, "").collect())
    sets = models.draw("Decision Tree", models.TRIALS)
    assert [r["trial"] for r in got] == list(range(models.TRIALS))
    for i in (0, 12, 27):
        alone = models.cross_validate(prepared.train, prepared.columns, "label", "Decision Tree", [sets[i]])
        assert got[i]["f1"] == round(alone[0], 6)
    largest = max(r["f1"] for r in got)
    assert [r["trial"] for r in got if r["best"]] == [min(r["trial"] for r in got if r["f1"] == largest)]


def test_tune_query_tells_the_parameters_of_every_trial(spark, prepared, monkeypatch):
    monkeypatch.setattr(learning, "learnable", lambda spark, d: prepared)
    got = learning.QUERIES["tune"](spark, "")
    assert got.columns == ["trial", "f1", "params", "best"]
    sets = models.draw("Decision Tree", models.TRIALS)
    assert {r["trial"]: r["params"] for r in got.collect()} == {i: str(p) for i, p in enumerate(sets)}


def test_regressions_in_common_scans_equal_the_estimator(spark, prepared, monkeypatch):
    sets = [{"C": c, "l1_ratio": r} for c, r in ((0.02, 1.0), (0.5, 0.0), (10.0, 0.4))]
    dealt = models.folds(prepared.train, "label", prepared.columns).localCheckpoint()
    table = logistic.stored(dealt, "vec", "label", "fold")
    scans = []
    sums = logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *a: scans.append(1) or sums(*a))
    tasks, wanted = {}, {}
    for i, p in enumerate(sets):
        rows = dealt if i == 2 else dealt.where(f"fold != {i}")
        n = rows.count()
        tasks[i] = logistic.Logistic(1.0 / (p["C"] * n), p["l1_ratio"], -1 if i == 2 else i)
        ready = rows.select(models.array_to_vector("vec").alias("features_vector"), "label")
        wanted[i] = models.estimator("Logistic Regression", p, n).setTol(1e-12).fit(ready)
    got = logistic.fit(table, tasks, 3)
    assert len(scans) < 40
    for i, model in wanted.items():
        assert np.abs(got[i] - [*model.coefficients, model.intercept]).max() < 1e-3, i


def test_regression_on_one_class_is_sure(spark):
    rows = spark.createDataFrame([([float(i)], 1.0, i % 2) for i in range(6)], "vec array<double>, label double, fold int")
    table = logistic.stored(rows, "vec", "label", "fold")
    assert logistic.fit(table, {0: logistic.Logistic(0.1, holdout=0)}, 1)[0].tolist() == [0.0, np.inf]
    assert logistic.fit(table.where("fold = 0"), {0: logistic.Logistic(0.1, holdout=0)}, 1) == {}
