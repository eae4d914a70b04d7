"""Class balance of the training rows, and the ways to even it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import hash_order, running_sum, smallest_by_hash
from headcount.operators.neighbours import METHODS
from headcount.session import cut_lineage

# Majority share in percent from which each scenario holds, its
# name, the advice given, and the strategy chosen.
SCENARIOS = (
    (99, "Extremely imbalanced", "Use cost-sensitive learning or anomaly detection techniques."),
    (95, "Highly imbalanced", "Must use SMOTE, undersampling, or cost-sensitive learning."),
    (80, "Getting imbalanced", "Use resampling, class weights, or ensemble methods."),
    (60, "Still manageable", "Try training as-is, maybe adjust metrics (Precision, Recall, F1-score)."),
    (0, "Ideal balance", "Train as usual, no special tricks needed."),
)
ONE_CLASS = "Only one class found in the target variable. Please check your data."
STRATEGIES = ((95, "smote_enn"), (80, "smote"), (60, "random_undersample"), (0, "none"))
SMOTE_NEIGHBOURS = 5
ENN_NEIGHBOURS = 3

# Classes of a target, each with one row in a broadcast.
MAX_CLASSES = 1000
# Rows one task makes from one vector before the rest goes to others.
CHUNK = 10_000


def _ladder(pct: Column, steps, item: int) -> Column:
    chosen = F.when(pct >= steps[0][0], steps[0][item])
    for step in steps[1:]:
        chosen = chosen.when(pct >= step[0], step[item])
    return chosen


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: share of the two largest classes, scenario, advice and strategy.

    The scenario follows from the share rounded to two decimals, the strategy
    from the share itself.
    """
    counts = (
        df.where(F.col(f"`{target}`").isNotNull()).groupBy(f"`{target}`").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = counts.agg(F.sum("n")).scalar()
    top = counts.orderBy(F.desc("n"), target).limit(2)
    pair = top.agg(
        F.count(F.lit(1)).alias("classes"), F.max("n").alias("major"), F.min("n").alias("minor")
    ).withColumn("rows", rows)
    share = F.col("major") / F.col("rows") * F.lit(100.0)
    major = F.bround(share, 2)
    minor = F.bround(F.col("minor") / F.col("rows") * F.lit(100.0), 2)
    two = F.col("classes") == 2
    ratio = F.concat(major.cast("string"), F.lit("% : "), minor.cast("string"), F.lit("%"))
    return pair.select(
        F.when(two, major).alias("majority_pct"),
        F.when(two, minor).alias("minority_pct"),
        F.when(two, ratio).alias("class_ratio"),
        F.when(two, _ladder(major, SCENARIOS, 1)).alias("scenario"),
        F.when(two, _ladder(major, SCENARIOS, 2)).otherwise(ONE_CLASS).alias("advice"),
        F.when(two, _ladder(share, STRATEGIES, 1)).otherwise("none").alias("strategy"),
    )


def choose_balancer(df: DataFrame, target: str) -> DataFrame:
    return class_balance(df, target).select("majority_pct", "strategy")


def random_undersample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Keep as many rows of each class as the smallest class has, in hash order of the key.

    Only counts of hash prefixes and the rows of one prefix per class are
    shuffled; the rest is a filter.
    """
    present = df.where(F.col(target).isNotNull())
    counts = present.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    smallest = counts.agg(F.struct(F.min("n").alias("n"), F.count(F.lit(1)).alias("classes"))).scalar()
    failure = F.raise_error(F.lit(f"'{target}' has more than {MAX_CLASSES} classes")).cast("bigint")
    wanted = counts.select(
        target, F.when(smallest["classes"] > MAX_CLASSES, failure).otherwise(smallest["n"]).alias("k")
    )
    # One row per class, and their number is checked above.
    limits = F.broadcast(smallest_by_hash(present, key, seed, [target], wanted))
    order = F.struct(hash_order(key, seed).alias("_hash"), F.col(key).alias("_key"))
    return present.join(limits, target).where(order <= F.col("last")).drop("last").select(*df.columns)


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _columns(features: list[str]) -> list[Column]:
    return [F.col("vec")[i].alias(c) for i, c in enumerate(features)]


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Repeat each row `n` times, numbered by `_i`; many copies are made by many tasks."""
    chunks = df.withColumn("_n", n).where(F.col("_n") > 0)
    chunks = chunks.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(CHUNK))))
    spread = chunks.repartition("vec", "_from")
    last = F.least(F.col("_from") + (CHUNK - 1), F.col("_n"))
    return spread.withColumn("_i", F.explode(F.sequence(F.col("_from"), last))).drop("_from", "_n")


def _pool(own: Column, copies: Column, neighbours: Column, k: int) -> Column:
    """The `k` nearest rows as vectors: copies of the own vector, then neighbours by distance."""
    same = F.array_repeat(own, F.least(copies, F.lit(k)).cast("int"))
    others = F.flatten(
        F.transform(
            neighbours, lambda x: F.array_repeat(x["vec"], F.least(x["sizes"][0], F.lit(k)).cast("int"))
        )
    )
    return F.slice(F.concat(same, others), 1, k)


def _hash_share(seed: int) -> Column:
    """A number in 0..1 that the vector and the copy's number fix."""
    parts = 1 << 53
    return F.pmod(F.xxhash64("vec", "_i", F.lit(seed)), F.lit(parts)) / F.lit(float(parts))


def synthetic_rows(
    minority: DataFrame,
    features: list[str],
    wanted: int,
    k: int = SMOTE_NEIGHBOURS,
    seed: int = 42,
    method: str = "exact",
) -> DataFrame:
    """`wanted` rows between minority rows and one of their `k` nearest minority rows.

    Equal rows are one vector with a count. Each vector gets its share of the
    wanted rows by the running total of the counts, so the shares add up exactly.
    """
    vectors = cut_lineage(
        minority.groupBy(_vector(features).alias("vec")).agg(F.array(F.count(F.lit(1))).alias("sizes"))
    )
    near = METHODS[method](vectors, k, seed)
    shared = running_sum(
        vectors.select("vec", F.col("sizes")[0].alias("_n")), [], ["vec"], "_n"
    )

    def upto(rows: Column) -> Column:
        product = rows.cast("decimal(19,0)") * F.lit(wanted).cast("decimal(18,0)")
        return F.floor(product / F.col("total").cast("decimal(19,0)")).cast("bigint")

    quota = upto(F.col("before") + F.col("_n")) - upto(F.col("before"))
    shares = shared.select("vec", quota.alias("_quota"), "_n")
    based = shares.join(near, "vec")
    pool = _pool(F.col("vec"), F.col("_n") - 1, F.col("neighbours"), k)
    made = _times(based.withColumn("_pool", pool).drop("neighbours", "_n"), F.col("_quota"))
    pick = F.pmod(F.xxhash64("vec", "_i", F.lit(seed)), F.size("_pool")).cast("int")
    u = _hash_share(seed + 1)
    towards = made.withColumns({"_other": F.get("_pool", pick), "_u": u})
    between = F.zip_with("vec", "_other", lambda a, b: a + F.col("_u") * (b - a))
    return towards.select(between.alias("vec")).select(*_columns(features))


def smote(
    df: DataFrame,
    target: str,
    features: list[str],
    k: int = SMOTE_NEIGHBOURS,
    seed: int = 42,
    method: str = "exact",
) -> DataFrame:
    """Features, target and `synthetic`: each class filled up to the largest one's size.

    `method` is `exact` or `hashed`, which finds most of the neighbours at a cost that
    does not grow with the number of features (see `neighbours`).
    """
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # The classes and their sizes, a row each, decide how many to make.
    sizes = {r[target]: r["n"] for r in counts.limit(MAX_CLASSES + 1).collect()}
    if len(sizes) < 2 or len(sizes) > MAX_CLASSES:
        raise ValueError(f"oversampling needs a target of two to {MAX_CLASSES} classes")
    most = max(sizes.values())
    result = own = df.where(F.col(target).isNotNull()).select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features], target, F.lit(False).alias("synthetic")
    )
    for label in sorted(c for c, n in sizes.items() if n < most):
        if sizes[label] <= k:
            raise ValueError(f"the class {label} has {sizes[label]} rows; more than {k} are needed")
        rows = own.where(F.col(target) == label)
        made = synthetic_rows(rows, features, most - sizes[label], k, seed, method)
        named = F.lit(label).cast(df.schema[target].dataType).alias(target)
        result = result.unionByName(made.select(*features, named, F.lit(True).alias("synthetic")))
    return result


def _equal_to(label: int):
    return lambda x: x == label


def edited_nearest(
    df: DataFrame,
    target: str,
    features: list[str],
    k: int = ENN_NEIGHBOURS,
    seed: int = 42,
    method: str = "exact",
) -> DataFrame:
    """Drop each row whose `k` nearest other rows are not all of its class (0 or 1).

    Equal rows are one vector with a count per class; rows are made again from
    the counts, so a vector with many copies is never gathered.
    """
    counts = [
        F.count_if((F.col(target) == c) & (F.col("synthetic") == s)).alias(f"n{c}{int(s)}")
        for c in (0, 1)
        for s in (False, True)
    ]
    grouped = df.groupBy(_vector(features).alias("vec")).agg(*counts)
    sized = cut_lineage(
        grouped.withColumn(
            "sizes", F.array(F.col("n00") + F.col("n01"), F.col("n10") + F.col("n11"))
        )
    )
    near = METHODS[method](sized.select("vec", "sizes"), k, seed)

    def classes(sizes: Column) -> Column:
        parts = [
            F.array_repeat(F.lit(c), F.least(F.greatest(sizes[c], F.lit(0)), F.lit(k)).cast("int"))
            for c in (0, 1)
        ]
        return F.concat(*parts)

    judged = sized.join(near, "vec")
    others = F.flatten(F.transform("neighbours", lambda x: classes(x["sizes"])))
    rows = []
    for c in (0, 1):
        left = F.array(*[F.col("sizes")[i] - (1 if i == c else 0) for i in (0, 1)])
        nearest = F.slice(F.concat(classes(left), others), 1, k)
        alike = F.forall(nearest, _equal_to(c))
        for s in (0, 1):
            rows.append(
                F.struct(
                    F.lit(c).alias("_class"),
                    F.lit(bool(s)).alias("synthetic"),
                    F.when(alike, F.col(f"n{c}{s}")).otherwise(F.lit(0)).alias("_copies"),
                )
            )
    kept = judged.select("vec", F.inline(F.array(*rows)))
    label = F.col("_class").cast(df.schema[target].dataType).alias(target)
    return _times(kept, F.col("_copies")).select(*_columns(features), label, "synthetic")


def smote_enn(
    df: DataFrame, target: str, features: list[str], seed: int = 42, method: str = "exact"
) -> DataFrame:
    """`smote`, then `edited_nearest` over all rows."""
    filled = smote(df, target, features, seed=seed, method=method)
    return edited_nearest(filled, target, features, seed=seed, method=method)


def balance(
    df: DataFrame, target: str, features: list[str], key: str, seed: int = 42, method: str = "exact"
) -> tuple[str, DataFrame]:
    """Apply the strategy that the class shares call for; one row decides."""
    strategy = class_balance(df, target).first()["strategy"]
    if strategy == "smote_enn":
        return strategy, smote_enn(df, target, features, seed, method).drop("synthetic")
    if strategy == "smote":
        return strategy, smote(df, target, features, seed=seed, method=method).drop("synthetic")
    chosen = df if strategy == "none" else random_undersample(df, target, key, seed)
    return strategy, chosen.select(*features, target)
