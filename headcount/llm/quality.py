"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades, and ordered thresholds cut its
sum: P(grade <= k) = logistic(threshold_k - score). The fit is by rounds of parameter
mixing: the bounded sample of rated documents is dealt to a fixed number of groups,
each takes some gradient steps from the common start, and the means are the next start.
The model gives an expected grade and the probability of the best grade.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Hashed features.
WIDTH = 1 << 18
#: Rated documents that a fit uses at most, chosen by the hash of their doc_id.
SAMPLE = 24_000
#: Documents of a group, rounds of mixing, and gradient steps of a round and of the last.
GROUP_ROWS, ROUNDS, STEPS, LAST_STEPS = 4000, 3, 100, 300
#: Step size, and the penalty on the size of weights times the root of a group's rows:
#: a feature that follows the grades no better than by chance keeps the weight 0. The
#: last round fits the features that have a weight without the penalty.
RATE, PENALTY = 0.3, 0.25
#: Probability of the best grade from which a document is kept.
KEEP = 0.5

#: Shares of words at which a count of odd words becomes a further feature.
STEPS_OF_SHARE = (0.02, 0.05, 0.1, 0.2, 0.4)
#: Lengths of the beginnings of a word that are features besides the word.
BEGINNINGS = (4, 5)
#: Words remembered with their features; the table is emptied when full.
MEMORY = 300_000


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


#: Word -> (hashed word, beginnings and odd ending; is upper case, is odd, is no word).
_known: dict[str, tuple[tuple[int, ...], bool, bool, bool]] = {}


def _word(token: str) -> tuple[tuple[int, ...], bool, bool, bool]:
    bare = token.strip(".,;:!?\"'()[]-")
    core = token.rstrip("".join(c for c in set(token) if not c.isalnum()))
    ending = token[len(core) :]
    odd = len(ending) > 1
    lower = (bare or token).lower()
    names = ["w " + lower, *("p " + lower[:n] for n in BEGINNINGS if len(lower) > n)]
    if odd:
        names.append("e " + ending)
    known = (
        tuple(_slot(name) for name in names),
        len(bare) > 2 and bare.isupper(),
        odd,
        not core,
    )
    if len(_known) >= MEMORY:
        _known.clear()
    _known[token] = known
    return known


def features(text: str | None) -> np.ndarray:
    """The sorted hashed features that a text has; a text without words has one."""
    tokens = (text or "").split()
    if not tokens:
        return np.array([_slot("no words")], dtype=np.int32)
    found, upper, odd, bare = set(), 0, 0, 0
    for token, n in Counter(tokens).items():
        slots, is_upper, is_odd, is_bare = _known.get(token) or _word(token)
        found.update(slots)
        upper += n * is_upper
        odd += n * is_odd
        bare += n * is_bare
    same = sum(map(str.__eq__, tokens, tokens[1:]))
    for name, n in (("upper", upper), ("odd", odd), ("bare", bare), ("same", same)):
        found.update(_slot(f"{name} {s}") for s in STEPS_OF_SHARE if n >= s * len(tokens))
    found.add(_slot(f"words {len(tokens).bit_length()}"))
    return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


@dataclass
class Model:
    """Weights and ordered thresholds; `grades` is None if nothing was rated."""

    grades: int | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, dtype=np.float32))
    first: float = -1.0
    gaps: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """2 for a good and harmless document, less one for each fault; null if unrated."""
    return (F.col(quality).cast("int") + 1 - F.col(toxic).cast("int")).cast("int")


def rated_sample(docs: DataFrame, ratings: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(rated_id, grade, found): features of at most `most` rated documents.

    `ratings` has doc_id and grade; rows with a null are passed over. The sample is of
    a fixed size, so it is broadcast to the documents.
    """
    chosen = (
        ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
        .select(F.col("doc_id").cast("long").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("rated_id"), "rated_id", "grade")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")
    )

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "rated_id": batch["rated_id"],
                    "grade": batch["grade"],
                    "found": [features(t) for t in batch["text"]],
                }
            )

    return rows.select("rated_id", "grade", "text").mapInPandas(
        found, "rated_id long, grade int, found array<int>"
    )


def _descend(rows: pd.DataFrame, model: Model, last: bool) -> Model:
    """Adaptive gradient steps on one group's rows."""
    y = rows["grade"].to_numpy()
    lengths = rows["found"].map(len).to_numpy()
    index = np.concatenate(rows["found"].to_list())
    row = np.repeat(np.arange(len(rows)), lengths)
    weights = model.weights.astype(np.float64)
    if last:
        used = weights[index] != 0
        index, row = index[used], row[used]
    shape = np.concatenate([[model.first], model.gaps])
    weight_power, shape_power = np.full(WIDTH, 1e-8), np.full(len(shape), 1e-8)
    top, n = model.grades - 1, len(y)
    penalty = 0.0 if last else PENALTY / np.sqrt(n)
    for _ in range(LAST_STEPS if last else STEPS):
        score = np.bincount(row, weights=weights[index], minlength=n)
        cuts = shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -30, 30)))
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        high, low = edge[np.arange(n), y + 1], edge[np.arange(n), y]
        slope = (1 - high - low) / n
        pull = np.bincount(index, weights=slope[row], minlength=WIDTH)
        mass = np.maximum(high - low, 1e-9)
        density = below * (1 - below)
        cut_pull = np.array(
            [
                ((y == k + 1) * density[:, k] / mass - (y == k) * density[:, k] / mass).mean()
                for k in range(top)
            ]
        )
        # a gap moves all thresholds from its own on
        tail = np.cumsum(cut_pull[::-1])[::-1]
        shape_pull = np.concatenate([[tail[0]], tail[1:] * np.exp(shape[1:])])
        weight_power += pull**2
        shape_power += shape_pull**2
        rate = RATE / np.sqrt(weight_power)
        weights -= rate * pull
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * penalty, 0.0)
        shape -= RATE * shape_pull / np.sqrt(shape_power)
    return Model(model.grades, weights.astype(np.float32), float(shape[0]), shape[1:])


def _stepper(start: Model, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        made = _descend(rows, start, last)
        shape = np.concatenate([[made.first], made.gaps])
        return pd.DataFrame(
            {"n": [len(rows)], "weights": [made.weights.tobytes()], "shape": [shape]}
        )

    return step


def fit(docs: DataFrame, ratings: DataFrame, grades: int, most: int = SAMPLE) -> Model:
    """The model of the sample; without rated documents, one that says nothing.

    What reaches the driver in a round is one weight vector per group.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample, path = scratch.keep(rated_sample(docs, ratings, most))
    rows = sample.count()
    if not rows:
        return Model()
    groups = -(-rows // GROUP_ROWS)
    dealt = sample.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "rated_id"), F.lit(groups)))
    model = Model(grades, gaps=np.zeros(grades - 2))
    for i in range(ROUNDS):
        parts = (
            dealt.groupBy("part")
            .applyInPandas(_stepper(model, i == ROUNDS - 1), "n long, weights binary, shape array<double>")
            .collect()
        )
        share = np.array([p.n for p in parts], dtype=np.float64)
        share /= share.sum()
        weights = sum(s * np.frombuffer(p.weights, dtype=np.float32) for s, p in zip(share, parts, strict=True))
        shape = sum(s * np.array(p["shape"]) for s, p in zip(share, parts, strict=True))
        model = Model(grades, weights.astype(np.float32), float(shape[0]), shape[1:])
    scratch.drop(path)
    return model


def with_grade(docs: DataFrame, model: Model) -> DataFrame:
    """Add expected_grade, tail_probability and keep; columns of these names are replaced.

    Without ratings both numbers are null and every document is kept. A null or empty
    text is graded by the one feature of having no words.
    """
    if model.grades is None:
        return docs.withColumns(
            {
                "expected_grade": F.lit(None).cast("double"),
                "tail_probability": F.lit(None).cast("double"),
                "keep": F.lit(True),
            }
        )
    weights = model.weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([float(weights[features(t)].sum()) for t in batch], dtype="float64")

    above = [
        F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(cut)) - F.col("graded_score")))
        for cut in model.thresholds()
    ]
    return (
        docs.withColumn("graded_score", score(F.col("text")))
        .withColumns(
            {"expected_grade": sum(above[1:], above[0]), "tail_probability": above[-1]}
        )
        .withColumn("keep", F.col("tail_probability") >= KEEP)
        .drop("graded_score")
    )


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` graded by the model of `labels` (doc_id, quality, toxic), three grades."""
    ratings = labels.select("doc_id", grade().alias("grade"))
    ratings = ratings.where(F.col("grade").between(0, 2))
    return with_grade(docs, fit(docs, ratings, 3))
