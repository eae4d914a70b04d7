"""Embedding whitening by an incremental eigendecomposition.

Every partition keeps a count, a mean and the eigenvectors and eigenvalues of the scatter
around that mean, and takes its vectors one by one: a vector is a rank-one change of the
scatter, whose new eigenvalues are the roots of a secular equation. Entries of the change
that are nothing and eigenvalues that are equal are deflated before. The spectra of
partitions are joined in a tree, again by rank-one changes: one for each eigenvector of
the one that comes in, and one for the distance of the means. What that gives is a basis;
a last pass over all vectors projects them on it and solves the small eigenproblem of the
projections (Rayleigh-Ritz), repeated with the image of the basis until the residuals
vanish, so the components do not depend on how vectors were dealt.

No task holds more than its Arrow batch and a square matrix of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Components, by falling eigenvalue.
COMPONENTS = 8
#: Share of the largest eigenvalue below which a direction carries no variance.
NOTHING = 1e-12
#: Spectra that one task joins.
FAN_IN = 8
#: Residual of the components, as a share of the eigenvalue, and passes to get there.
RESIDUAL, PASSES = 1e-9, 20
#: Components up to this size become integers of a long with room for sums.
LARGEST = 2.0**36
#: The largest long.
LONG = 2**63 - 1

#: Steps to a root of the secular equation at most, and the rounding and the least of doubles.
HALVINGS, EPS, TINY = 80, np.finfo(float).eps, np.finfo(float).tiny

SPECTRUM = "part long, count long, mean array<double>, basis array<double>, values array<double>"


def secular(values: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(values) + change change', values rising.

    Needs distinct values and no zero in `change` (see `rank_one`). Root j lies between
    value j and the next, the last below the largest plus the square of the change. Each
    is held as a distance from the closer of the two, so that differences keep their
    relative accuracy, and found by rational steps inside an interval that is halved where
    a step leaves it. The vectors come from the change whose roots are exactly those
    found, which keeps them orthogonal.
    """
    m = len(values)
    square = change * change
    gaps = np.append(np.diff(values), square.sum())
    origin = np.arange(m)
    middle = values + gaps / 2
    if m > 1:
        # the side of the interval that holds the root: f rises from -inf to +inf on it
        f = 1 + (square[None, :] / (values[None, :] - middle[:-1, None])).sum(axis=1)
        origin[:-1] += f < 0
    shifted = values[None, :] - values[origin][:, None]
    right = origin != np.arange(m)
    low = np.where(right, -gaps / 2, 0.0)
    high = np.where(right, 0.0, gaps / 2)
    high[-1] = gaps[-1]
    left = np.tri(m)
    mid = (low + high) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(HALVINGS):
            apart = shifted - mid[:, None]
            terms = square / apart
            slopes = terms / apart
            below, all_of, slope = (terms * left).sum(axis=1), terms.sum(axis=1), slopes.sum(axis=1)
            f = 1 + all_of
            done = np.abs(f) <= 8 * EPS * (1 + np.abs(below) + np.abs(all_of - below))
            if done.all():
                break
            low, high = np.where(f < 0, mid, low), np.where(f < 0, high, mid)
            # the root of constant + s / (one - step) + t / (two - step), which has the value
            # and slope of the terms on either side
            slope_below = (slopes * left).sum(axis=1)
            one = np.diagonal(apart)
            step = one + one * one * slope_below / (f - one * slope_below)
            if m > 1:
                one, two = one[:-1], np.diagonal(apart, 1)
                constant = f[:-1] - one * slope_below[:-1] - two * (slope - slope_below)[:-1]
                linear = (one + two) * f[:-1] - one * two * slope[:-1]
                root = np.sqrt(np.maximum(linear * linear - 4 * one * two * f[:-1] * constant, 0))
                step[:-1] = np.where(
                    linear <= 0, (linear - root) / (2 * constant), 2 * one * two * f[:-1] / (linear + root)
                )
            moved = mid + step
            moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
            mid = np.where(done, mid, moved)
    near = shifted - mid[:, None]  # value i less root j, at [j, i]
    near[near == 0] = TINY
    # |change_i|: the product over roots against the product over the other values, in pairs
    between = values[None, :] - values[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = -near / between.T
    np.fill_diagonal(ratio, -np.diagonal(near))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(change)
    vectors = exact[None, :] / near
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return values[origin] + mid, vectors.T


def rank_one(values: np.ndarray, basis: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigendecomposition of basis diag(values) basis' + step step'; values rise.

    The part of `step` outside the basis becomes a new direction while there are fewer
    than dimensions.
    """
    along = basis.T @ step
    rest = step - basis @ along
    more = basis.T @ rest
    rest -= basis @ more
    along += more
    length = np.linalg.norm(rest)
    size = np.linalg.norm(step)
    if not size:
        return values, basis
    if basis.shape[1] < len(step) and length > 1e-13 * size:
        basis = np.column_stack([rest / length, basis])
        values = np.append(0.0, values)
        along = np.append(length, along)
    order = np.argsort(values, kind="stable")
    values, basis, along = values[order], basis[:, order], along[order]
    scale = max(values[-1], size * size)
    # equal eigenvalues: turn their plane so that only the later has a part in the change
    small = 8 * EPS
    last = None
    for i in range(len(values)):
        if abs(along[i]) * size <= small * scale:
            along[i] = 0.0
            continue
        if last is not None and values[i] - values[last] <= small * scale:
            both = np.hypot(along[last], along[i])
            c, s = along[i] / both, along[last] / both
            one, two = basis[:, last].copy(), basis[:, i].copy()
            basis[:, last], basis[:, i] = c * one - s * two, s * one + c * two
            along[last], along[i] = 0.0, both
        last = i
    live = np.flatnonzero(along)
    if len(live):
        found, turn = secular(values[live], along[live])
        values, basis = values.copy(), basis.copy()
        values[live], basis[:, live] = found, basis[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of vectors."""

    def __init__(self, width: int):
        self.count, self.mean = 0, np.zeros(width)
        self.values, self.basis = np.empty(0), np.empty((width, 0))

    def add(self, vector: np.ndarray) -> None:
        """One vector more: the scatter changes by its distance from the mean."""
        apart = vector - self.mean
        self.count += 1
        self.mean = self.mean + apart / self.count
        step = apart * np.sqrt((self.count - 1) / self.count)
        self.values, self.basis = rank_one(self.values, self.basis, step)

    def join(self, count: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray) -> None:
        """All vectors of another spectrum more, an eigenvector at a time."""
        for value, vector in zip(values, basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, np.sqrt(value) * vector)
        total = self.count + count
        apart = mean - self.mean
        step = apart * np.sqrt(self.count * (count / total))
        self.values, self.basis = rank_one(self.values, self.basis, step)
        self.mean = self.mean + apart * (count / total)
        self.count = total

    def row(self, part: int) -> pd.DataFrame:
        basis, _ = np.linalg.qr(self.basis) if self.basis.size else (self.basis, None)  # rounding of many turns
        held = {"part": part, "count": self.count, "mean": self.mean, "basis": basis.ravel(), "values": self.values}
        return pd.DataFrame({k: [v] for k, v in held.items()})


def _spectra(width: int, start: np.ndarray) -> Callable:
    """One spectrum per partition, of vectors less a fixed integer vector close to the mean."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part = Spectrum(width), 0
        for batch in batches:
            for x, p in zip(batch["x"], batch["part"], strict=True):
                own.add((np.asarray(x, np.int64) - start).astype(float))
                part = p
        if own.count:
            yield own.row(int(part))

    return collect


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    width = len(group["mean"].iloc[0])
    own = Spectrum(width)
    for row in group.sort_values("part").itertuples():
        basis = np.asarray(row.basis, float).reshape(width, -1)
        if own.count:
            own.join(row.count, np.asarray(row.mean, float), np.asarray(row.values, float), basis)
        else:
            own.count, own.mean = row.count, np.asarray(row.mean, float)
            own.values, own.basis = np.asarray(row.values, float), basis
    return own.row(int(group["part"].min()) // FAN_IN)


def spectrum(vectors: DataFrame, start: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the scatter of `x`, by rank-one changes."""
    width = len(start)
    numbered = vectors.select("x", F.spark_partition_id().cast("long").alias("part"))
    found, path = scratch.keep(numbered.mapInPandas(_spectra(width, start), SPECTRUM))
    while found.count() > 1:
        group = F.floor(F.col("part") / FAN_IN)
        found, written = scratch.keep(found.groupBy(group.alias("to")).applyInPandas(_joined, SPECTRUM))
        scratch.drop(path)
        path = written
    row = found.first()  # one square matrix of the dimensions
    return np.asarray(row["values"], float), np.asarray(row["basis"], float).reshape(width, -1)


def _added(vectors: DataFrame, parts: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The sum of matrices that `parts` makes of the batches' `x`, added up in the shuffle."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                one = parts(np.array(batch["x"].to_list(), dtype=np.int64))
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    summed = vectors.select("x").mapInPandas(collect, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = {r["at"]: r["v"] for r in summed.collect()}  # as many as the matrix has entries
    return np.array([flat[i] for i in range(len(flat))]).reshape(rows, -1)


def refine(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ritz values (falling), vectors and the trace of the covariance, from a basis.

    A pass adds up V basis and the trace, for the covariance V. The small eigenproblem
    of basis' V basis gives the components; while a residual of the first `wanted` is
    too large, V basis is the next basis.
    """
    for _ in range(PASSES):
        held = basis

        def image(x: np.ndarray, held: np.ndarray = held) -> np.ndarray:
            centred = (x * n - sums) / n
            return np.column_stack([centred.T @ (centred @ held), (centred * centred).sum(axis=0)])

        total = _added(vectors, image, len(sums)) / n
        images, trace = total[:, :-1], float(total[:, -1].sum())
        small = held.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        components = held @ turn
        rest = np.linalg.norm(images @ turn - components * values, axis=0)[:wanted]
        if (rest <= RESIDUAL * np.maximum(values[:wanted], NOTHING * values[0])).all():
            break
        basis, _ = np.linalg.qr(images)
    return values, components, trace


def integers(embedding: Column) -> Column:
    """floor(1024 c) + 100000 of each component; null where the vector takes no part."""
    wide = embedding.cast("array<double>")
    usable = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    scaled = F.transform(wide, lambda c: F.floor(c * 1024).cast("long") + 100_000)
    return F.when(usable & (F.size(wide) > 0), scaled)


def _whitened(n: int, sums: np.ndarray, values: np.ndarray, components: np.ndarray, explained: np.ndarray, error: float) -> Callable:
    exact = [int(s) for s in sums]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(values)
        for batch in batches:
            if not len(batch):
                continue
            apart = np.array(batch["x"].to_list(), dtype=np.int64) * n - sums
            largest = int(np.abs(apart).max(initial=0))
            if largest * largest * len(exact) <= LONG:
                deviation = (apart * apart).sum(axis=1).tolist()
            else:
                whole = [sum(int(a) ** 2 for a in row) for row in apart]
                deviation = [d if d <= LONG else None for d in whole]
            white = (apart / n) @ components / np.sqrt(values)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1), len(batch)),
                    "n": n,
                    "deviation": pd.Series(deviation, dtype="Int64").repeat(k).to_numpy(),
                    "whitened": white.ravel(),
                    "explained": np.tile(explained, len(batch)),
                    "identity_error": error,
                }
            )

    return project


WHITE = (
    "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of all vectors.

    `rows` has vec_id and embedding; other columns are not read. Components become the
    integers x = floor(1024 c) + 100000; everything is about these: n vectors with sums
    S, covariance V with divisor n. One row per vector and component, numbered by falling
    eigenvalue e of V: deviation is the sum of (n x - S)^2, exact, null beyond a long;
    whitened is x - S/n on the component over the root of e; explained is e over the
    trace; identity_error is the largest entry by which the covariance of all whitened
    values is not the identity. The largest entry of a component is positive.

    Vectors that are null or empty, or hold null, NaN, infinite components or components
    beyond `LARGEST`, take no part; if lengths differ, the commonest does (the longer of
    those that tie). Repeated rows each count and are returned, with a null vec_id too.
    Directions without variance (equal vectors, one vector) are no components. An empty
    table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    usable, _ = scratch.keep(
        rows.select(F.col("vec_id").cast("string").alias("vec_id"), integers(F.col("embedding")).alias("x")).where(
            F.col("x").isNotNull()
        )
    )
    lengths = usable.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], WHITE.replace("vec_id string", "vec_id long"))
    width, n = most["width"], most["n"]
    vectors = usable.where(F.size("x") == width)
    total = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    sums = np.array([r["v"] for r in sorted(total.collect())], dtype=np.int64)
    _, basis = spectrum(vectors, sums // n, scratch)
    if not basis.shape[1]:
        return spark.createDataFrame([], WHITE.replace("vec_id string", "vec_id long"))
    values, found, trace = refine(vectors, n, sums, np.ascontiguousarray(basis[:, ::-1]), components)
    live = min(components, int((values > NOTHING * values[0]).sum()))
    values, found = values[:live], found[:, :live]
    found = found / np.linalg.norm(found, axis=0)
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(live)])

    def products(x: np.ndarray) -> np.ndarray:
        white = ((x * n - sums) / n) @ found / np.sqrt(values)
        return np.vstack([white.sum(axis=0), white.T @ white])

    moments = _added(vectors, products, live + 1) / n
    covariance = moments[1:] - np.outer(moments[0], moments[0])
    error = float(np.abs(covariance - np.eye(live)).max())
    out = vectors.mapInPandas(_whitened(n, sums, values, found, values / trace, error), WHITE)
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))
