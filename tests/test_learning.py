"""Linear verifiers recover a planted signal."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajmill import schemas as S
from trajmill.learning import newton
from trajmill.learning import verifiers as L
from trajmill.operators import metrics as M

WORDS = [f"w{i}" for i in range(30)]


def answer(rng, good):
    words = rng.sample(WORDS, 6) + (["right"] if good else ["wrong"]) * 2
    rng.shuffle(words)
    return [("assistant", " ".join(words))]


def test_pair_verifier(spark):
    rng = random.Random(0)
    data = [([("user", "q")], answer(rng, True), answer(rng, False)) for _ in range(200)]
    pairs = spark.createDataFrame(data, S.PAIRS)
    model = L.train_pair_verifier(pairs, l2=0.001)
    assert model.intercept == 0.0
    for side in ("chosen", "rejected"):
        view = pairs.withColumn("completion", F.col(side))
        pairs = L.score_rollouts(model, view, f"{side}_reward").drop("completion")
    got = M.pair_verifier_metrics(pairs).first()
    assert got["accuracy"] > 0.9 and got["reward_margin"] > 0


def test_binary_verifier(spark):
    rng = random.Random(1)
    data = [([("user", "q")], answer(rng, i % 2 == 0), i % 2 == 0) for i in range(300)]
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(data, f"prompt {message}, completion {message}, label boolean")
    model = L.train_binary_verifier(df, l2=0.001)
    scored = L.score_rollouts(model, df)
    assert scored.columns == ["prompt", "completion", "label", "reward"]
    assert M.binary_verifier_metrics(scored).first()["accuracy"] > 0.9


def test_features_use_first_message_and_completion(spark):
    message = "array<struct<role:string,content:string>>"
    data = [([("user", "first"), ("assistant", "skipped"), ("user", "also")], [("assistant", "last")])]
    df = spark.createDataFrame(data, f"prompt {message}, completion {message}")
    text = df.select(L.verifier_text(F.col("prompt"), F.col("completion"))).first()[0]
    assert text == "user:first\nassistant:last"


def planted(rng, n):
    """Rows of some words of 12, labels drawn from a known scorer."""
    weights = [rng.gauss(0, 1.5) for _ in range(12)]
    rows = []
    for _ in range(n):
        ids = [rng.randrange(12) for _ in range(rng.randrange(0, 9))]
        chance = 1 / (1 + math.exp(-sum(weights[i] for i in ids) - 0.5))
        rows.append((ids, float(rng.random() < chance)))
    return rows


def by_gradient(rows, l2, size=12):
    """The same minimum by many plain gradient steps."""
    x = np.array([np.bincount(ids, minlength=size) for ids, _ in rows], dtype=float)
    x, y = np.hstack([x, np.ones((len(x), 1))]), np.array([label for _, label in rows])
    w, penalty = np.zeros(size + 1), np.array([l2] * size + [0.0])
    for _ in range(20000):
        w -= 0.1 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + penalty * w)
    return w


@pytest.mark.parametrize("parts", [1, 5])
def test_newton_is_the_minimum_of_gradient_steps(spark, parts):
    data = planted(random.Random(2), 400)
    df = spark.createDataFrame(data, "ids array<int>, label double").repartition(parts)
    model = newton.fit(df, 12, 0.02)
    want = by_gradient(data, 0.02)
    assert model.passes <= 12 and model.slope < 1e-6
    assert np.allclose(model.coefficients, want[:12], atol=1e-4) and abs(model.intercept - want[12]) < 1e-4
    slopes = [r["slope"] for r in L.gradient(model, df, 0.02).collect()]
    assert max(map(abs, slopes)) < 1e-6


def test_newton_odd_tables(spark):
    kinds = "ids array<int>, label double"
    empty = newton.fit(spark.createDataFrame([], kinds), 4, 0.1)
    assert empty.coefficients.tolist() == [0.0] * 4 and empty.intercept == 0.0
    # No words, and words that decide the label alone: the penalty bounds the weights.
    plain = newton.fit(spark.createDataFrame([([], 1.0), ([], 0.0), ([], 0.0)], kinds), 4, 0.1)
    assert abs(plain.intercept - math.log(0.5)) < 1e-6
    split = newton.fit(spark.createDataFrame([([1], 1.0), ([2], 0.0)] * 50, kinds), 4, 0.001, most_passes=40)
    assert split.slope < 1e-6 and split.coefficients[1] > 2 and split.coefficients[2] < -2
    with pytest.raises(ValueError):
        newton.fit(spark.createDataFrame([], kinds), 4, 0.0)


def test_held_out_loss_tells_signal_from_noise(spark):
    rng = random.Random(5)
    for signal in (True, False):
        data = planted(rng, 1200)
        if not signal:
            data = [(ids, float(rng.random() < 0.5)) for ids, _ in data]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "ID int, ids array<int>, label double")
        model = newton.fit(df.where("ID % 5 > 0").drop("ID"), 12, 0.01)
        held = [r for i, r in enumerate(data) if i % 5 == 0]
        margins = [sum(model.coefficients[i] for i in ids) + model.intercept for ids, _ in held]
        loss = sum(math.log1p(math.exp(-m if y else m)) for m, (_, y) in zip(margins, held)) / len(held)
        assert (loss < 0.95 * math.log(2)) == signal
