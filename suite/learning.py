"""Queries and their SQL: feature preparation, balancing, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from headcount.operators import balance, features, models, neighbours, scoring, trees
from headcount.operators.quality import clean
from headcount.plans import prediction
from headcount.session import cut_lineage
from suite.analysis import rounded
from suite.tables import _CLEANED
from suite.views import employees, table, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_hot_sql() -> str:
    made = [
        f"CASE WHEN Department = '{v}' THEN 1 ELSE 0 END::DOUBLE AS \"Department_{v}\"" for v in _LEVELS[1:]
    ]
    made.append('CASE WHEN Department IS NULL THEN 1 ELSE 0 END::DOUBLE AS "Department_nan"')
    made.append("CASE WHEN Gender = 'Male' THEN 1 ELSE 0 END::DOUBLE AS \"Gender_Male\"")
    return f"SELECT EmployeeID, {', '.join(made)} FROM hr_employees"


@query("one_hot", _one_hot_sql())
def _(spark, d):
    source = employees(spark, d).select("EmployeeID", "Department", "Gender")
    return features.one_hot(source, ["Department", "Gender"])


@query(
    "min_max_scale",
    """SELECT EmployeeID, round((Salary - (SELECT min(Salary) FROM hr_employees))
         / (SELECT max(Salary) - min(Salary) FROM hr_employees), 6) AS Salary,
       round((JobLevel - 1) / 4::DOUBLE, 6) AS JobLevel, 0::DOUBLE AS Same FROM hr_employees""",
)
def _(spark, d):
    source = employees(spark, d).select("EmployeeID", "Salary", "JobLevel", F.lit(7).alias("Same"))
    return rounded(features.min_max_scale(source, ["Salary", "JobLevel", "Same"]))


_SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || EmployeeID::VARCHAR), EmployeeID)
  <= ceil((SELECT count(*) FROM hr_employees) * 20 / 100::DOUBLE) AS is_test FROM hr_employees)"""


@query("train_test_split", f"WITH {_SPLIT} SELECT EmployeeID, Turnover, is_test FROM split")
def _(spark, d):
    source = employees(spark, d).select("EmployeeID", "Turnover")
    return features.train_test_split(source, "EmployeeID", 20, 42)


def _balance_sql(target: str) -> str:
    steps = " ".join(f"WHEN major >= {p} THEN '{s}'" for p, s, _ in balance.SCENARIOS)
    advice = " ".join(f"WHEN major >= {p} THEN '{a}'" for p, _, a in balance.SCENARIOS)
    strategies = " ".join(f"WHEN share >= {p} THEN '{s}'" for p, s in balance.STRATEGIES)
    return f"""WITH {_SPLIT}, c AS (SELECT {target}, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1),
      s AS (SELECT max(n) / sum(n)::DOUBLE * 100 AS share, min(n) / sum(n)::DOUBLE * 100 AS rest FROM c),
      r AS (SELECT share, round_even(share, 2) AS major, round_even(rest, 2) AS minor FROM s)
      SELECT major AS majority_pct, minor AS minority_pct,
        major::VARCHAR || '% : ' || minor::VARCHAR || '%' AS class_ratio,
        CASE {steps} END AS scenario, CASE {advice} END AS advice, CASE {strategies} END AS strategy FROM r"""


def training_rows(spark, d):
    split = features.train_test_split(employees(spark, d), "EmployeeID", 20, 42)
    return split.where(~F.col("is_test"))


for _target in ("Turnover", "RareTarget", "Veteran", "Gender"):
    query(f"class_balance_{_target.lower()}", _balance_sql(_target))(
        lambda spark, d, t=_target: balance.class_balance(training_rows(spark, d), t)
    )


@query(
    "choose_balancer",
    f"SELECT majority_pct, strategy FROM ({_balance_sql('RareTarget')})",
)
def _(spark, d):
    return balance.choose_balancer(training_rows(spark, d), "RareTarget")


@query(
    "random_undersample",
    """WITH r AS (SELECT EmployeeID, Turnover, Salary,
         row_number() OVER (PARTITION BY Turnover ORDER BY md5('42:' || EmployeeID::VARCHAR), EmployeeID) AS rn
         FROM hr_employees)
       SELECT EmployeeID, Turnover, Salary FROM r WHERE rn <=
         (SELECT min(n) FROM (SELECT count(*) AS n FROM hr_employees GROUP BY Turnover))""",
)
def _(spark, d):
    source = employees(spark, d).select("EmployeeID", "Turnover", "Salary")
    return balance.random_undersample(source, "Turnover", "EmployeeID")


_CATEGORIES = ["Gender", "DEIGroup"]
_NUMBERS = ["JobLevel", "Salary", "Engagement", "TrainingHours"]


def cleaned(spark, d):
    return clean(employees(spark, d), _CLEANED)


def encoded(spark, d, target):
    """The cleaned table, encoded and scaled, with the target as a 0/1 label."""
    source = cut_lineage(cleaned(spark, d).select("EmployeeID", target, *_CATEGORIES, *_NUMBERS))
    plan = features.fit_features(source, _CATEGORIES, _NUMBERS)
    return plan, plan.transform(features.with_target(source, target), ["EmployeeID", "label"])


@query("smote")
def _(spark, d):
    plan, ready = encoded(spark, d, "Veteran")
    return balance.smote(ready, "label", plan.outputs)


@query(
    "smote_counts",
    """WITH k AS (SELECT Veteran, count(*) AS n FROM hr_employees WHERE Department IS NOT NULL GROUP BY 1)
       SELECT CASE Veteran WHEN 'Yes' THEN 1 ELSE 0 END::DOUBLE AS label, n AS "real",
         (SELECT max(n) FROM k) - n AS made FROM k""",
)
def _(spark, d):
    plan, ready = encoded(spark, d, "Veteran")
    return (
        balance.smote(ready, "label", plan.outputs)
        .groupBy("label")
        .agg(F.count_if(~F.col("synthetic")).alias("real"), F.count_if(F.col("synthetic")).alias("made"))
    )


@query("smote_enn")
def _(spark, d):
    plan, ready = encoded(spark, d, "RareTarget")
    return balance.smote_enn(ready, "label", plan.outputs)


# --- neighbours -------------------------------------------------------------

# Three numbers per customer; some customers share all of them.
_PLACES = """p AS (SELECT DISTINCT c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE * 10 AS y,
  (c_custkey % 7)::DOUBLE * 100 AS z FROM customer)"""


def places(spark, d):
    c = table(spark, d, "customer")
    vec = F.array(
        F.col("c_acctbal").cast("double"),
        F.col("c_nationkey").cast("double") * 10,
        (F.col("c_custkey") % 7).cast("double") * 100,
    )
    return cut_lineage(c.groupBy(vec.alias("vec")).agg(F.array(F.count(F.lit(1))).alias("sizes")))


@query(
    "nearest_vectors",
    f"""WITH {_PLACES}, d AS (SELECT a.x, a.y, a.z, b.x AS ox, b.y AS oy, b.z AS oz,
          (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS square
          FROM p a JOIN p b ON (a.x, a.y, a.z) <> (b.x, b.y, b.z)),
        r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY square, ox, oy, oz) AS rn FROM d)
        SELECT x, y, z, rn::INT AS rank, ox AS near_x, round(square, 6) AS square FROM r WHERE rn <= 5""",
)
def _(spark, d):
    found = neighbours.nearest_vectors(places(spark, d), 5)
    flat = found.select("vec", F.posexplode("neighbours").alias("pos", "near"))
    return flat.select(
        *[F.col("vec")[i].alias(c) for i, c in enumerate("xyz")],
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("near.vec")[0].alias("near_x"),
        F.round("near.square", 6).alias("square"),
    )


@query(
    "hashed_vectors",
    f"WITH {_PLACES} SELECT count(*) AS vectors, 5 * count(*) AS neighbours, true AS found_most FROM p",
)
def _(spark, d):
    vectors = places(spark, d)
    # fewer and smaller buckets than by default, so that a small table has several
    exact = neighbours.nearest_vectors(vectors, 5).select("vec", F.explode("neighbours.vec").alias("near"))
    hashed = neighbours.hashed_vectors(vectors, 5, bucket_rows=200).select("vec", F.explode("neighbours.vec").alias("near"))
    both = hashed.join(exact.withColumn("true", F.lit(1)), ["vec", "near"], "left")
    return both.agg(
        F.count_distinct("vec").alias("vectors"),
        F.count(F.lit(1)).alias("neighbours"),
        (F.count("true") >= 0.9 * F.count(F.lit(1))).alias("found_most"),
    )


# --- trees ------------------------------------------------------------------

# A target with noise: most large orders with little discount, and some returned goods.
_TOLD = "CASE WHEN l_quantity * (1 - l_discount) > 24 OR l_returnflag = 'R' AND l_tax > 0.05 THEN 1 ELSE 0 END"
_TREE_FEATURES = ["l_discount", "l_quantity", "l_tax"]


def told(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(*[F.col(c).cast("double").alias(c) for c in _TREE_FEATURES], F.expr(_TOLD).cast("double").alias("y"))


def _node_sql(name: str, where: str, worth: str) -> str:
    """The best cut of a node: sums per feature and value, running up, each as a split."""
    return f"""{name}_v AS (SELECT f, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS o FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS f, {c}::DOUBLE AS v, y FROM t WHERE {where}" for c in _TREE_FEATURES)}) GROUP BY f, v),
      {name}_c AS (SELECT f, v, sum(n) OVER up AS ln, sum(o) OVER up AS lo, sum(n) OVER (PARTITION BY f) AS n,
        sum(o) OVER (PARTITION BY f) AS o FROM {name}_v WINDOW up AS (PARTITION BY f ORDER BY v)),
      {name} AS (SELECT f, v, ln, lo, n, o, {worth.format(n="ln", o="lo")} + {worth.format(n="(n - ln)", o="(o - lo)")}
        - {worth.format(n="n", o="o")} AS gain FROM {name}_c WHERE ln < n ORDER BY gain DESC, f, v LIMIT 1)"""


_TREE_ROWS = f"t AS (SELECT l_discount, l_quantity, l_tax, {_TOLD} AS y FROM lineitem)"
_GINI = "(-2 * {n} * ({o} / {n}) * (1 - {o} / {n}))"
_NEWTON = "(0.5 * ({n} * 0.5 - {o}) * ({n} * 0.5 - {o}) / ({n} * 0.25 + 1))"
_AT_ROOT = "CASE (SELECT f FROM root) WHEN 'l_discount' THEN l_discount WHEN 'l_quantity' THEN l_quantity ELSE l_tax END::DOUBLE"


def _shown(tree, cuts, nodes: dict[str, int]) -> list[tuple]:
    return [
        (name, _TREE_FEATURES[tree.feature[n]], float(cuts[tree.feature[n]][tree.cut[n]]), round(tree.value[n], 6), round(tree.gain[n], 4))
        for name, n in nodes.items()
    ]


@query(
    "tree_splits",
    f"""WITH {_TREE_ROWS}, {_node_sql("root", "true", _GINI)},
        {_node_sql("low", f"{_AT_ROOT} <= (SELECT v FROM root)", _GINI)},
        {_node_sql("high", f"{_AT_ROOT} > (SELECT v FROM root)", _GINI)},
        every AS (SELECT 'root' AS node, * FROM root UNION ALL SELECT 'low', * FROM low UNION ALL SELECT 'high', * FROM high)
        SELECT node, f AS feature, v AS cut, round(o / n, 6) AS share, round(gain, 4) AS gain FROM every""",
)
def _(spark, d):
    rows = told(spark, d)
    cuts = trees.cuts_of(rows, _TREE_FEATURES)
    stored = trees.binned(rows, _TREE_FEATURES, "y", cuts)
    tree = trees.classify(stored, {0: trees.Growth(max_depth=2)}, {0: trees.Sample()}, 3, trees.MAX_BINS)[0]
    low = tree.left[0]
    shown = _shown(tree, cuts, {"root": 0, "low": low, "high": low + 1})
    return spark.createDataFrame(shown, "node string, feature string, cut double, share double, gain double")


@query(
    "boost_first_split",
    f"""WITH {_TREE_ROWS}, {_node_sql("root", "true", _NEWTON)}
        SELECT f AS feature, v AS cut, round(gain, 4) AS gain,
          round(-(ln * 0.5 - lo) / (ln * 0.25 + 1), 6) AS low, round(-((n - ln) * 0.5 - (o - lo)) / ((n - ln) * 0.25 + 1), 6) AS high
        FROM root""",
)
def _(spark, d):
    rows = told(spark, d)
    cuts = trees.cuts_of(rows, _TREE_FEATURES)
    stored = trees.binned(rows, _TREE_FEATURES, "y", cuts)
    growth = trees.Growth("newton", max_depth=1, min_weight=1.0)
    _start, made = trees.boost(stored, {0: trees.Boost(1, growth=growth)}, 3, trees.MAX_BINS)[0]
    (_, feature, cut, _, gain), low = _shown(made[0], cuts, {"root": 0})[0], made[0].left[0]
    sides = [round(made[0].value[low + i], 6) for i in (0, 1)]
    return spark.createDataFrame([(feature, cut, gain, *sides)], "feature string, cut double, gain double, low double, high double")


# --- models -----------------------------------------------------------------


# A target that the features tell exactly, so that a model that learns has known figures.
_SIGNAL = "CASE WHEN JobLevel >= 4 THEN 'Yes' ELSE 'No' END"


def signalled(spark, d):
    return cleaned(spark, d).withColumn("Signal", F.when(F.col("JobLevel") >= 4, "Yes").otherwise("No"))


def learnable(spark, d):
    return prediction.prepare(signalled(spark, d), "Signal", "EmployeeID", _CATEGORIES, _NUMBERS)


_PERFECT = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in models.MODELS)


@query(
    "train_compare",
    f"""WITH n AS (SELECT count(*) FILTER (WHERE {_SIGNAL} = 'Yes') / count(*) FILTER (WHERE JobLevel >= 4)::DOUBLE
         AS one FROM hr_employees), m AS ({_PERFECT})
        SELECT model, one AS accuracy, one AS "precision", one AS recall, one AS f1, one AS roc_auc,
          3 * one AS custom_score, row_number() OVER (ORDER BY model) = 1 AS best FROM m, n""",
)
def _(spark, d):
    ready = learnable(spark, d)
    ranked, _models = models.train_compare(ready.train, ready.test, ready.columns, "label")
    return rounded(ranked)


# Trials that see all features and take the best cuts find the target whole; what the
# others find follows from their draws. The best trial is the first with the largest score.
_TREE_TRIALS = models.draw("Decision Tree", models.TRIALS)
_WHOLE = [i for i, p in enumerate(_TREE_TRIALS) if p["splitter"] == "best" and p["max_features"] is None]


def tuned_trials(spark, d):
    ready = learnable(spark, d)
    return models.tune(ready.train, ready.columns, "label", "Decision Tree").trials


# The figures and the parameters of every trial. What the trials that see some features find
# depends on their draws, which no SQL has; `tune_best` is the part that SQL can tell.
@query("tune")
def _(spark, d):
    return rounded(tuned_trials(spark, d))


@query(
    "tune_best",
    f"""WITH n AS (SELECT count(*) FILTER (WHERE {_SIGNAL} = 'Yes') / count(*) FILTER (WHERE JobLevel >= 4)::DOUBLE
         AS one FROM hr_employees)
        SELECT CAST(i AS INT) AS trial, CASE WHEN i IN ({", ".join(map(str, _WHOLE))}) THEN one END AS whole_f1,
          true AS in_range, true AS best_is_first_largest FROM n, range(0, {models.TRIALS}) t(i)""",
)
def _(spark, d):
    trials = tuned_trials(spark, d)
    largest = trials.agg(F.max("f1")).scalar()
    first = trials.where(F.col("f1") == largest).agg(F.min("trial")).scalar()
    return rounded(
        trials.select(
            "trial",
            F.when(F.col("trial").isin(_WHOLE), F.col("f1")).alias("whole_f1"),
            F.col("f1").between(0, 1).alias("in_range"),
            (F.col("best") == (F.col("trial") == first)).alias("best_is_first_largest"),
        )
    )


@query(
    "score_batch",
    f"""SELECT EmployeeID, {_SIGNAL} AS "Predicted Turnover", JobLevel >= 4 AS likely
        FROM hr_employees WHERE Department IS NOT NULL""",
)
def _(spark, d):
    source = cut_lineage(signalled(spark, d))
    ready = prediction.prepare(source, "Signal", "EmployeeID", _CATEGORIES, _NUMBERS)
    _tuned, scored = prediction.tune_and_score(ready, source, "Logistic Regression")
    return scored.select(
        "EmployeeID", "Predicted Turnover", (F.col("Probability") > 0.5).alias("likely")
    )


# Made-up predictions with an exact check: the discount as score, the tax as label.
_CALLED = """p AS (SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y,
  CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS h, l_discount * 10 AS s FROM lineitem)"""


def called(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("y"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("h"),
        (F.col("l_discount") * 10).alias("s"),
    )


_FIGURES = """count(*) FILTER (WHERE y = h) / count(*)::DOUBLE AS accuracy,
  count(*) FILTER (WHERE y = 1 AND h = 1) / count(*) FILTER (WHERE h = 1)::DOUBLE AS precision,
  count(*) FILTER (WHERE y = 1 AND h = 1) / count(*) FILTER (WHERE y = 1)::DOUBLE AS recall,
  2 * count(*) FILTER (WHERE y = 1 AND h = 1)
    / (count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE h = 1))::DOUBLE AS f1"""


@query(
    "classification_metrics",
    f"""WITH {_CALLED}, m AS (SELECT {_FIGURES} FROM p) SELECT round(accuracy, 6) AS accuracy,
        round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m""",
)
def _(spark, d):
    return rounded(scoring.classification_metrics(called(spark, d), "y", "h"))


@query(
    "roc_auc",
    f"""WITH {_CALLED}, v AS (SELECT s, count(*) AS t, count(*) FILTER (WHERE y = 1) AS n FROM p GROUP BY 1),
        r AS (SELECT n, t, coalesce(sum(t) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + (t + 1) / 2::DOUBLE AS rank FROM v),
        z AS (SELECT sum(n * rank) AS ranks, sum(n)::DOUBLE AS n1, sum(t - n)::DOUBLE AS n0 FROM r)
        SELECT round((ranks - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS roc_auc FROM z""",
)
def _(spark, d):
    return rounded(scoring.roc_auc(called(spark, d), "y", "s"))


_CUTS = (0.03, 0.05, 0.07)


@query(
    "rank_models",
    "WITH "
    + ", ".join(
        f"""m{i} AS (SELECT 'cut {c}' AS model, {_FIGURES.replace("h = 1", f"d >= {c}").replace("y = h", f"(y = 1) = (d >= {c})")}
            FROM (SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y, l_discount AS d FROM lineitem))"""
        for i, c in enumerate(_CUTS)
    )
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_CUTS)))
    + """), r AS (SELECT *, f1 + recall + "precision" AS total FROM a)
      SELECT model, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall,
        round(f1, 6) AS f1, round(total, 6) AS custom_score,
        row_number() OVER (ORDER BY total DESC, accuracy DESC, model) = 1 AS best FROM r""",
)
def _(spark, d):
    parts = []
    for cut in _CUTS:
        rows = table(spark, d, "lineitem").select(
            F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("y"),
            F.when(F.col("l_discount") >= cut, 1).otherwise(0).alias("h"),
        )
        parts.append(
            scoring.classification_metrics(rows, "y", "h").withColumn("model", F.lit(f"cut {cut}"))
        )
    results = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(scoring.rank_models(results))
