"""Training, tuning and applying turnover classifiers with Spark ML."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from headcount.functions.ordering import running_sum
from headcount.operators import logistic, trees
from headcount.operators.features import FeaturePlan
from headcount.operators.scoring import evaluate, rank_models
from headcount.session import cut_lineage

# The models on offer, and what each is trained with by default.
MODELS = ("Logistic Regression", "Decision Tree", "Random Forest", "xgboost", "LightGBM")
DEFAULTS: dict[str, dict] = {
    "Logistic Regression": {"C": 1.0, "max_iter": 1000, "l1_ratio": 0.0},
    "Decision Tree": {
        "criterion": "gini",
        "splitter": "best",
        "max_depth": 30,
        "min_samples_split": 2,
        "min_samples_leaf": 1,
        "max_features": None,
    },
    "Random Forest": {"n_estimators": 100, "max_depth": 30, "min_samples_leaf": 1},
    "xgboost": {
        "n_estimators": 100,
        "max_depth": 6,
        "learning_rate": 0.3,
        "subsample": 1.0,
        "colsample": 1.0,
    },
    "LightGBM": {
        "n_estimators": 100,
        "max_depth": 5,
        "learning_rate": 0.1,
        "num_leaves": 31,
        "subsample": 1.0,
        "colsample": 1.0,
    },
}
# The ranges that tuning draws from.
SPACES: dict[str, dict] = {
    "Logistic Regression": {"C": (0.01, 10.0), "max_iter": (100, 1000), "penalty": ["l1", "l2", "elasticnet"]},
    "Decision Tree": {
        "criterion": ["gini", "entropy", "log_loss"],
        "splitter": ["best", "random"],
        "max_depth": (2, 20),
        "min_samples_split": (2, 10),
        "min_samples_leaf": (1, 5),
        "max_features": [None, "sqrt", "log2"],
    },
    "Random Forest": {"n_estimators": (50, 300), "max_depth": (2, 20), "min_samples_leaf": (1, 5)},
    "xgboost": {
        "n_estimators": (50, 300),
        "max_depth": (2, 12),
        "learning_rate": (0.01, 0.3),
        "subsample": (0.5, 1.0),
        "colsample": (0.5, 1.0),
    },
    "LightGBM": {
        "n_estimators": (50, 300),
        "max_depth": (2, 12),
        "learning_rate": (0.01, 0.3),
        "num_leaves": (20, 100),
    },
}
FOLDS = 3
TRIALS = 30
#: Models whose trees are grown on binned counts, many at a time.
GROWN = ("Decision Tree", "xgboost", "LightGBM")
_VECTOR, _LABEL = "features_vector", "label"


def assembled(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """The feature columns as one vector, and the label as `label`."""
    made = VectorAssembler(inputCols=features, outputCol=_VECTOR).transform(df)
    if label is None:
        return made
    return made.select(_VECTOR, F.col(label).cast("double").alias(_LABEL))


def estimator(name: str, params: dict, rows: int, seed: int = 42):
    """The Spark estimator for a model's parameters; `rows` scales the penalty of the first."""
    if name not in DEFAULTS:
        raise ValueError(f"no model '{name}'; known: {', '.join(MODELS)}")
    p = DEFAULTS[name] | params
    common = {"featuresCol": _VECTOR, "labelCol": _LABEL}
    if name == "Logistic Regression":
        return LogisticRegression(
            maxIter=int(p["max_iter"]),
            regParam=1.0 / (p["C"] * max(rows, 1)),
            elasticNetParam=float(p["l1_ratio"]),
            standardization=False,
            **common,
        )
    if name in GROWN:
        return GrownTrees(name, p, seed)
    if name == "Random Forest":
        return RandomForestClassifier(
            numTrees=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy="sqrt",
            seed=seed,
            **common,
        )


def growth(name: str, p: dict, width: int, seed: int = 42) -> trees.Growth:
    """How the trees of a model grow on `width` features.

    One boosted model grows level by level, with a penalty on leaf values and a least
    curvature; the other the best leaf first, from the log odds, with a least number of
    rows in a leaf and no penalty.
    """
    if name == "Decision Tree":
        count = {None: width, "sqrt": int(width**0.5), "log2": int(math.log2(width))}[p["max_features"]]
        return trees.Growth(
            "gini" if p["criterion"] == "gini" else "entropy",
            int(p["max_depth"]),
            p["min_samples_split"],
            p["min_samples_leaf"],
            None if count == width else (max(1, count) + 0.5) / width,
            p["splitter"] == "random",
            seed=seed,
        )
    own = {"min_weight": 1.0} if name == "xgboost" else {"leaves": int(p["num_leaves"]), "l2": 0.0, "min_leaf": 20, "min_weight": 1e-3}
    return trees.Growth("newton", int(p["max_depth"]), seed=seed, **own)


def grown(
    table: DataFrame, cuts: list, name: str, tasks: dict[int, tuple[dict, int]], seed: int = 42
) -> dict[int, trees.GrownModel]:
    """A model for each (parameters, fold held out) of `tasks`, all grown in the same scans."""
    width = len(cuts)
    full = {i: (DEFAULTS[name] | params, fold) for i, (params, fold) in tasks.items()}
    growths = {i: growth(name, p, width, seed) for i, (p, _) in full.items()}
    if name == "Decision Tree":
        samples = {i: trees.Sample(fold) for i, (_, fold) in full.items()}
        made = trees.classify(table, growths, samples, width, trees.MAX_BINS)
        return {i: trees.GrownModel(cuts, [tree]) for i, tree in made.items()}
    boosts = {
        i: trees.Boost(
            int(p["n_estimators"]),
            float(p["learning_rate"]),
            growths[i],
            trees.Sample(fold, float(p["subsample"]), float(p["colsample"])),
            name == "LightGBM",
        )
        for i, (p, fold) in full.items()
    }
    made = trees.boost(table, boosts, width, trees.MAX_BINS)
    return {i: trees.GrownModel(cuts, own, start, boosts[i].rate) for i, (start, own) in made.items()}


def all_rows(name: str, sets: list[dict]) -> bool:
    """Whether every tree of these models sees all rows that it is given."""
    return all((DEFAULTS[name] | p).get("subsample", 1.0) >= 1 for p in sets)


class GrownTrees:
    """Fits one of the grown models to a column of vectors, as Spark's estimators do."""

    def __init__(self, name: str, params: dict, seed: int = 42):
        self.name, self.params, self.seed = name, params, seed

    def getImpurity(self) -> str:  # noqa: N802 - as Spark's trees name it
        return growth(self.name, self.params, 1, self.seed).criterion

    def fit(self, ready: DataFrame) -> trees.GrownModel:
        first = ready.select(F.size(vector_to_array(_VECTOR)).alias("n")).first()
        names = [f"f{i}" for i in range(first["n"] if first else 0)]
        rows = ready.select(*[vector_to_array(_VECTOR)[i].alias(c) for i, c in enumerate(names)], _LABEL)
        cuts = trees.cuts_of(rows, names)
        table = trees.binned(rows, names, _LABEL, cuts, merged=all_rows(self.name, [self.params]))
        return grown(table, cuts, self.name, {0: (self.params, -1)}, self.seed)[0]


def train(
    df: DataFrame, features: list[str], label: str, name: str, params: dict | None = None, seed: int = 42
) -> Model:
    """Fit one model on a prepared table."""
    ready = assembled(df, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator(name, params or {}, ready.count(), seed).fit(ready)
    finally:
        ready.unpersist()


def predict(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """Add `prediction` and `score`, the probability of class 1."""
    scored = model.transform(assembled(df, features))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        _VECTOR, "rawPrediction", "probability"
    )


def train_compare(
    train_rows: DataFrame,
    test_rows: DataFrame,
    features: list[str],
    label: str,
    names: tuple[str, ...] = MODELS,
    overrides: dict[str, dict] | None = None,
    seed: int = 42,
) -> tuple[DataFrame, dict[str, Model]]:
    """Train the named models and score each on the test rows.

    Returns one row of figures per model, best marked, and the fitted models.
    """
    spark = train_rows.sparkSession
    ready = assembled(train_rows, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    held = test_rows.select(label, *features).persist(StorageLevel.MEMORY_AND_DISK)
    fitted, rows = {}, []
    try:
        count = ready.count()
        for name in names:
            fitted[name] = estimator(name, (overrides or {}).get(name, {}), count, seed).fit(ready)
            scored = predict(fitted[name], held, features).select(label, "prediction", "score")
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            # Five numbers per model.
            figures = evaluate(scored, label, "prediction", "score").first()
            rows.append((name, *[None if f is None else float(f) for f in figures]))
            scored.unpersist()
    finally:
        ready.unpersist()
        held.unpersist()
    schema = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double"
    return rank_models(spark.createDataFrame(rows, schema)), fitted


def folds(
    df: DataFrame, label: str, features: list[str], count: int = FOLDS, seed: int = 42
) -> DataFrame:
    """(label, vec, fold): the rows dealt in turn to the folds, class by class.

    Rows of a class are taken in hash order, and copies of a row one after the other,
    so a class has the same number of rows in each fold, give or take one. Equal rows
    are counted before the shuffle.
    """
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    counts = (
        df.select(F.col(f"`{label}`").cast("double").alias("label"), vec.alias("vec"))
        .where(F.col("label").isNotNull())
        .groupBy("label", "vec")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hash", F.xxhash64(F.lit(seed), "label", "vec"))
    )
    placed = running_sum(counts, ["label"], ["_hash", "vec"], "_n")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    turn = F.pmod(F.col("before") + F.col("_copy"), F.lit(count)).cast("int")
    return placed.withColumn("_copy", copy).select("label", "vec", turn.alias("fold"))


def draw(name: str, trials: int, seed: int = 42) -> list[dict]:
    """Parameter sets drawn at random from the model's space, the same for each seed."""
    source = random.Random(seed)
    space = SPACES[name]
    sets = []
    for _ in range(trials):
        p = {}
        for key, range_ in space.items():
            if isinstance(range_, list):
                p[key] = source.choice(range_)
            elif isinstance(range_[0], int):
                p[key] = source.randint(*range_)
            else:
                p[key] = source.uniform(*range_)
        if name == "Logistic Regression":
            mixed = source.uniform(0.0, 1.0)
            p["l1_ratio"] = {"l1": 1.0, "l2": 0.0, "elasticnet": mixed}[p["penalty"]]
        sets.append(p)
    return sets


@dataclass(frozen=True)
class Tuned:
    name: str
    params: dict
    score: float
    model: Model
    trials: DataFrame


def cross_validate(
    df: DataFrame,
    features: list[str],
    label: str,
    name: str,
    sets: list[dict],
    seed: int = 42,
    parallelism: int = 4,
) -> list[float]:
    """Mean F1 of class 1 over the folds per parameter set; NaN where a fold cannot tell.

    Models grown on counts, and regressions of up to `logistic.WIDE` features, are fitted
    all at once; of others `parallelism` fits run at a time, each on the stored folds.
    """
    dealt = cut_lineage(folds(df, label, features, seed=seed))
    if name in GROWN:
        return _cross_validate_grown(dealt, len(features), name, sets, seed)
    if name == "Logistic Regression" and len(features) <= logistic.WIDE:
        return _cross_validate_logistic(dealt, len(features), sets)
    ready = dealt.select(
        array_to_vector("vec").alias(_VECTOR), F.col("label").alias(_LABEL), "fold"
    ).persist(StorageLevel.MEMORY_AND_DISK)
    judge = MulticlassClassificationEvaluator(
        labelCol=_LABEL, metricName="fMeasureByLabel", metricLabel=1.0
    )
    try:
        # One row per fold.
        sizes = {r["fold"]: r["count"] for r in ready.groupBy("fold").count().collect()}

        def score(task: tuple[int, dict]) -> float:
            fold, params = task
            rest = sum(n for f, n in sizes.items() if f != fold)
            if not sizes.get(fold) or not rest:
                return float("nan")
            fitted = estimator(name, params, rest, seed).fit(ready.where(F.col("fold") != fold))
            return judge.evaluate(fitted.transform(ready.where(F.col("fold") == fold)))

        tasks = [(fold, params) for params in sets for fold in range(FOLDS)]
        with ThreadPool(min(parallelism, max(1, len(tasks)))) as pool:
            scores = pool.map(score, tasks)
    finally:
        ready.unpersist()
    return [sum(scores[i : i + FOLDS]) / FOLDS for i in range(0, len(scores), FOLDS)]


def _cross_validate_grown(dealt: DataFrame, width: int, name: str, sets: list[dict], seed: int) -> list[float]:
    """All trials and folds at once: the scans do not depend on how many there are."""
    names = [f"f{i}" for i in range(width)]
    rows = dealt.select(*[F.col("vec")[i].alias(c) for i, c in enumerate(names)], "label", "fold")
    cuts = trees.cuts_of(rows, names)
    table = trees.binned(rows, names, "label", cuts, "fold", all_rows(name, sets))
    tasks = {i * FOLDS + fold: (params, fold) for i, params in enumerate(sets) for fold in range(FOLDS)}
    models = grown(table, cuts, name, tasks, seed)
    # One row per trial and fold.
    held = trees.confusion(table, {t: (tasks[t][1], model) for t, model in models.items()}, width)
    rows = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    return _mean_f1({r["model"]: r for r in held.collect()}, rows, len(tasks))


def _cross_validate_logistic(dealt: DataFrame, width: int, sets: list[dict]) -> list[float]:
    """As for grown models: a scan serves all trials and folds."""
    table = logistic.stored(dealt, "vec", "label", "fold")
    sizes = {r["fold"]: r["count"] for r in table.groupBy("fold").count().collect()}
    rows = sum(sizes.values())
    tasks = {}
    for i, params in enumerate(sets):
        p = DEFAULTS["Logistic Regression"] | params
        for fold in range(FOLDS):
            rest = max(rows - sizes.get(fold, 0), 1)
            tasks[i * FOLDS + fold] = logistic.Logistic(1.0 / (p["C"] * rest), float(p["l1_ratio"]), fold, int(p["max_iter"]))
    fitted = logistic.fit(table, tasks, width)
    counts = {}
    if fitted:
        held = logistic.confusion(table, {t: (tasks[t].holdout, w) for t, w in fitted.items()}, width)
        counts = {r["model"]: r for r in held.collect()}
    return _mean_f1(counts, rows, len(tasks))


def _mean_f1(counts: dict, rows: int, tasks: int) -> list[float]:
    """Mean F1 over the folds per trial, from the counts of each task on its held out fold."""

    def score(task: int) -> float:
        own = counts.get(task)
        if own is None or not own["rows"] or own["rows"] == rows:
            return float("nan")
        wrong = own["false"] + own["missed"]
        return 2 * own["hit"] / (2 * own["hit"] + wrong) if own["hit"] + wrong else 0.0

    scores = [score(t) for t in range(tasks)]
    return [sum(scores[i : i + FOLDS]) / FOLDS for i in range(0, len(scores), FOLDS)]


def best_trial(scores: list[float]) -> int:
    """The first trial with the best score; an undefined score loses to every other."""
    return max(range(len(scores)), key=lambda i: float("-inf") if scores[i] != scores[i] else scores[i])


def tune(
    df: DataFrame,
    features: list[str],
    label: str,
    name: str,
    trials: int = TRIALS,
    seed: int = 42,
    parallelism: int = 4,
) -> Tuned:
    """Random search: the drawn set with the best cross-validated F1, refitted on all rows."""
    sets = draw(name, trials, seed)
    scores = cross_validate(df, features, label, name, sets, seed, parallelism)
    best = best_trial(scores)
    known = [None if s != s else s for s in scores]
    table = df.sparkSession.createDataFrame(
        [(i, s, str(p), i == best) for i, (s, p) in enumerate(zip(known, sets))],
        "trial int, f1 double, params string, best boolean",
    )
    model = train(df, features, label, name, sets[best], seed)
    return Tuned(name, sets[best], scores[best], model, table)


def fit_best(
    df: DataFrame, features: list[str], label: str, tuned: Tuned, seed: int = 42
) -> Model:
    """Refit the winning parameters on another table."""
    return train(df, features, label, tuned.name, tuned.params, seed)


def score_batch(
    plan: FeaturePlan,
    model: Model,
    batch: DataFrame,
    features: list[str],
    dates: tuple[str, ...] = (),
) -> DataFrame:
    """The batch with Predicted Turnover (Yes/No) and Probability; also for one record."""
    # The input travels along whole while its columns are encoded.
    whole = batch.withColumn("_input", F.struct(*[F.col(f"`{c}`") for c in batch.columns]))
    scored = predict(model, plan.prepare_batch(whole, ["_input"], dates), features)
    return scored.select(
        "_input.*",
        F.when(F.col("prediction") == 1, "Yes").otherwise("No").alias("Predicted Turnover"),
        F.col("score").alias("Probability"),
    )
