"""Ordinal regression: held-out accuracy, gradient, and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from headcount.llm import quality

DOCS = "doc_id long, text string, keep string, grade string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900):
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "enu", "iri", "oma", "uta", "esti")]
    docs, labels = [], []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(5, 200))
        good, toxic = draw.random() < 0.8, draw.random() < 0.2
        if toxic:
            text.insert(draw.randrange(len(text)), draw.choice(["rotter", "swinehead"]))
        if not good:
            text = [w + "$$$" for w in text]
        docs.append((i, " ".join(text), "clash", "clash"))
        labels.append((i, int(good), int(toxic), "x"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    ratings = spark.createDataFrame(labels[:600], LABELS).select("doc_id", quality.grade().alias("grade"))
    model = quality.fit(frame, ratings, 3)
    assert list(model.thresholds()) == sorted(model.thresholds())
    got = {r.doc_id: r for r in quality.with_grade(frame, model).collect()}
    right = sum(got[i].keep == (q == 1 and t == 0) for i, q, t, _ in labels[600:])
    assert right >= 0.95 * 300
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    again = quality.fit(frame.repartition(5), ratings.repartition(3), 3)
    assert np.allclose(again.weights, model.weights, atol=1e-4)


def test_steps_lower_the_loss():
    draw = np.random.default_rng(0)
    rows = pd.DataFrame(
        {
            "grade": draw.integers(0, 4, 300),
            "found": [np.unique(draw.integers(0, 50, 8)).astype(np.int32) for _ in range(300)],
        }
    )
    rows["found"] = [np.append(f, 100 + g) for f, g in zip(rows["found"], rows["grade"], strict=True)]

    def loss(model):
        cuts = model.thresholds()
        total = 0.0
        for g, f in zip(rows["grade"], rows["found"], strict=True):
            below = 1 / (1 + np.exp(model.weights[f].sum() - cuts))
            edge = np.concatenate([[0.0], below, [1.0]])
            total -= np.log(edge[g + 1] - edge[g])
        return total

    start = quality.Model(4, gaps=np.zeros(2))
    made = quality._descend(rows, start, False)
    relaxed = quality._descend(rows, made, True)
    assert loss(relaxed) < loss(made) < loss(start)


def test_edges(spark):
    docs, labels = corpus(60)
    docs += [(None, "null id", "a", "b"), (1000, None, "a", "b"), (1001, "", "a", "b"), (1002, "word " * 200_000, "a", "b")]
    docs += docs[:3]
    labels += [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 1, None, "x"), *labels[:5]]
    frame = spark.createDataFrame(docs, DOCS)
    got = quality.graded(frame, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["doc_id", "text", "keep", "grade", "expected_grade", "tail_probability"]
    assert got.count() == len(docs) and got.where("tail_probability is null").count() == 0
    unrated = quality.graded(frame, spark.createDataFrame([], LABELS)).collect()
    assert len(unrated) == len(docs) and all(r.keep and r.expected_grade is None for r in unrated)
    empty = spark.createDataFrame([], DOCS)
    assert quality.graded(empty, spark.createDataFrame(labels, LABELS)).collect() == []


@pytest.mark.parametrize("text", [None, "", " \n", "a" * 300_000, "!!! ???", "É é | |"])
def test_features(text):
    found = quality.features(text)
    assert len(found) and list(found) == sorted(set(found.tolist()))
