"""Logistic regressions with penalties, many of them in the same scans.

Every model is improved by Newton steps. A scan adds up, for each model still open, its
loss, gradient and curvature over the rows it sees; the driver holds these sums only (a
square of the number of features per model), and steps to the minimum of the quadratic
they give plus the penalty, by coordinates where that has corners. A step that does not
lower the objective is halved.

The objective is the one of Spark's estimator without standardisation: the mean loss, plus
`penalty` times (`l1_ratio` times the sum of sizes, plus half the rest times the sum of
squares) of the coefficients; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.operators.packed import batch_of, matrix, numbers, packed, spread
from headcount.session import cut_lineage

#: Features up to which the curvature of many models is held at once.
WIDE = 40
#: Products of features that a task holds at a time.
HELD = 2_000_000
#: A step that lowers the objective by a smaller share is the last.
SMALL = 1e-8
#: Sweeps over the coordinates, and halvings of a step, at most.
SWEEPS, HALVINGS = 1000, 30


@dataclass(frozen=True)
class Logistic:
    """One model: its penalty as above, the fold held out, and the most steps."""

    penalty: float
    l1_ratio: float = 0.0
    holdout: int = -1
    steps: int = 1000


def stored(df: DataFrame, vec: str, label: str, fold: str, key: str = "id") -> DataFrame:
    """(id, x, y, fold): the table that models are fitted on, from arrays of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x")
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                at = batch.schema.get_field_index("x")
                yield batch.set_column(at, "x", packed(rows))

    rows = df.select(
        F.monotonically_increasing_id().alias(key),
        F.col(vec).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.col(fold).cast("int").alias("fold"),
    )
    made = cut_lineage(rows.mapInArrow(pack, f"{key} long, x binary, y double, fold int"))
    return cut_lineage(spread(made, made.count(), key))


def _with_one(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = matrix(batch.column("x"), width, np.float64)
    return np.column_stack([x, np.ones(len(x))])


def _adding(models: dict[int, Logistic], at: dict[int, np.ndarray], width: int):
    """Adds up loss, gradient and upper curvature of each model over the rows of a task."""
    upper = np.triu_indices(width + 1)
    order = list(at)
    weights = np.column_stack([at[m] for m in order])
    held_out = np.array([models[m].holdout for m in order])
    size = max(64, HELD // len(upper[0]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + width + 1 + len(upper[0]), len(order)))
        for batch in batches:
            every, y, fold = _with_one(batch, width), numbers(batch, "y"), numbers(batch, "fold")
            for start in range(0, len(y), size):
                part = slice(start, start + size)
                x, one = every[part], (y[part] == 1).astype(float)[:, None]
                used = fold[part, None] != held_out
                margin = x @ weights
                chance = 0.5 * (1.0 + np.tanh(margin / 2))
                total[0] += (used * (np.logaddexp(0.0, margin) - one * margin)).sum(axis=0)
                total[1 : width + 2] += x.T @ (used * (chance - one))
                total[width + 2 :] += (x[:, upper[0]] * x[:, upper[1]]).T @ (used * chance * (1 - chance))
        yield batch_of({"model": np.array(order), "sums": packed(total.T)}, {"model": pa.int32(), "sums": pa.binary()})

    return add


def _sums(table: DataFrame, models: dict[int, Logistic], at: dict[int, np.ndarray], width: int) -> dict[int, np.ndarray]:
    size = width + 2 + (width + 1) * (width + 2) // 2
    made = table.mapInArrow(_adding(models, at, width), "model int, sums binary")
    out = {m: np.zeros(size) for m in at}
    # one row per task and model
    for row in made.collect():
        out[row["model"]] += np.frombuffer(bytes(row["sums"]))
    return out


def _target(gradient: np.ndarray, curve: np.ndarray, at: np.ndarray, model: Logistic) -> np.ndarray:
    """Where the quadratic of gradient and curvature at a place is least, with the penalty."""
    soft, square = model.penalty * model.l1_ratio, model.penalty * (1 - model.l1_ratio)
    width = len(at) - 1
    curve, gradient = curve.copy(), gradient.copy()
    bent = np.arange(width)
    curve[bent, bent] += square
    gradient[:width] += square * at[:width]
    curve[np.arange(width + 1), np.arange(width + 1)] += 1e-12
    if not soft:
        return at - np.linalg.solve(curve, gradient)
    to = at.copy()
    slope = gradient.copy()  # of the quadratic at `to`
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(width + 1):
            free = to[j] - slope[j] / curve[j, j]
            new = free if j == width else np.sign(free) * max(0.0, abs(free) - soft / curve[j, j])
            step = new - to[j]
            if step:
                to[j] = new
                slope += curve[j] * step
                moved = max(moved, step * step * curve[j, j])
        if moved < 1e-16:
            break
    return to


def _objective(loss: float, at: np.ndarray, model: Logistic) -> float:
    w = at[:-1]
    return loss + model.penalty * (model.l1_ratio * np.abs(w).sum() + (1 - model.l1_ratio) / 2 * (w * w).sum())


def fit(table: DataFrame, models: dict[int, Logistic], width: int) -> dict[int, np.ndarray]:
    """Coefficients and, last, the intercept of each model; null where it sees no rows.

    Where a model sees one class its intercept is infinite, as the estimator's.
    """
    counts = table.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("ones")).collect()
    rows, at, done = {}, {}, {}
    for m, model in models.items():
        own = [r for r in counts if r["fold"] != model.holdout]
        n, ones = sum(r["n"] for r in own), sum(r["ones"] for r in own)
        start = np.zeros(width + 1)
        if 0 < ones < n:
            start[-1] = np.log(ones / (n - ones))
            rows[m], at[m] = n, start
        elif n:
            start[-1] = np.inf if ones else -np.inf
            done[m] = start
    best: dict[int, tuple[float, np.ndarray]] = {}
    taken, halved = dict.fromkeys(at, 0), dict.fromkeys(at, 0)
    upper = np.triu_indices(width + 1)
    while at:
        sums, following = _sums(table, models, at, width), {}
        for m, here in at.items():
            model, found = models[m], sums[m] / rows[m]
            value = _objective(found[0], here, model)
            if m in best and not value <= best[m][0]:
                halved[m] += 1
                if halved[m] <= HALVINGS:
                    following[m] = (here + best[m][1]) / 2
                    continue
                done[m] = best[m][1]
                continue
            last = best.get(m)
            best[m], halved[m], taken[m] = (value, here), 0, taken[m] + 1
            if taken[m] > model.steps or last and last[0] - value <= SMALL * abs(last[0]):
                done[m] = here
                continue
            curve = np.zeros((width + 1, width + 1))
            curve[upper] = found[width + 2 :]
            curve += np.triu(curve, 1).T
            following[m] = _target(found[1 : width + 2], curve, here, model)
        at = following
    return done


def confusion(table: DataFrame, models: dict[int, tuple[int, np.ndarray]], width: int) -> DataFrame:
    """(model, hit, false, missed, rows): counts on the rows of each model's holdout fold."""
    weights = np.column_stack([w for _, w in models.values()])
    held_out = np.array([holdout for holdout, _ in models.values()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(models)), dtype=np.int64)
        for batch in batches:
            said = _with_one(batch, width) @ weights > 0
            true = (numbers(batch, "y") == 1)[:, None]
            own = numbers(batch, "fold")[:, None] == held_out
            total += [(own & x).sum(axis=0) for x in (said & true, said & ~true, ~said & true, np.ones_like(said))]
        found = dict(zip(("model", "hit", "false", "missed", "rows"), (list(models), *total), strict=True))
        yield batch_of(found, {n: pa.int32() if n == "model" else pa.int64() for n in found})

    return (
        table.mapInArrow(count, "model int, hit long, false long, missed long, rows long")
        .groupBy("model")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "false", "missed", "rows")])
    )
