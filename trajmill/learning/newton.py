"""Logistic regression over hashed words by distributed Newton steps.

A row is the list of its words' numbers. Every pass adds up, over all tasks, the loss, its first
derivatives and the matrix of second derivatives at the present weights; the step is solved on
the driver, which gets one matrix of the weights' number squared whatever the table's size. A step
that raises the loss is halved. Close to the minimum each pass doubles the correct digits, so a
handful of them reach a zero gradient, where gradient steps need hundreds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are made dense at a time.
ROWS = 2048
#: Tasks of a pass: each sends one matrix.
TASKS = 256


@dataclass
class LinearModel:
    """Weights and intercept; ``slope`` is the largest derivative there, ``loss`` the objective."""

    coefficients: np.ndarray
    intercept: float
    passes: int
    slope: float
    loss: float


def _dense(ids: pd.Series, signs: pd.Series | None, size: int) -> np.ndarray:
    """Counts of each number in each row; with signs, sums of them."""
    counts = ids.map(len).to_numpy()
    flat = np.concatenate([*ids, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(ids)), counts)
    weights = None if signs is None else np.concatenate([*signs, np.zeros(0)])
    cells = np.bincount(rows * size + flat, weights, minlength=len(ids) * size)
    return cells.reshape(len(ids), size).astype(float)


def _sums(weights: np.ndarray, dimensions: int, intercept: bool, signed: bool):
    """Per task: the rows of the matrix, each ended by its first derivative, and (loss, rows) last."""
    size = dimensions + intercept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, seen = np.zeros((size, size + 1)), 0.0, 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x = _dense(part["ids"], part["signs"] if signed else None, dimensions)
                if intercept:
                    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                margin = x @ weights
                label = part["label"].to_numpy(dtype=float)
                chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss += float(np.sum(np.logaddexp(0, margin) - label * margin))
                seen += len(x)
                total[:, :size] += x.T @ (x * (chance * (1 - chance))[:, None])
                total[:, size] += x.T @ (chance - label)
        ends = np.zeros(size + 1)
        ends[:2] = loss, seen
        yield pd.DataFrame({"row": np.arange(size + 1), "cells": [*total, ends]})

    return run


def fit(
    rows: DataFrame,
    dimensions: int,
    l2: float,
    intercept: bool = True,
    tolerance: float = 1e-7,
    most_passes: int = 30,
) -> LinearModel:
    """Minimise the mean logistic loss plus l2 / 2 times the squared weights (not the intercept).

    ``rows`` are (ids array<int>, label 0 or 1) and, for sums of signed words, (signs array<double>). Every
    pass reads them again: give a stored table. Stops where no derivative exceeds the tolerance.
    An empty table gives zero weights.
    """
    if l2 <= 0:
        raise ValueError("l2 must be positive: it makes the minimum exist and the matrix invertible")
    size, signed = dimensions + intercept, "signs" in rows.columns
    penalty = np.full(size, float(l2))
    penalty[dimensions:] = 0
    narrow = rows.select("ids", *(["signs"] if signed else []), F.col("label").cast("double").alias("label")).coalesce(TASKS)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = narrow.mapInPandas(_sums(weights, dimensions, intercept, signed), "row int, cells array<double>")
        summed = parts.groupBy("row").agg(Summarizer.sum(array_to_vector("cells")).alias("cells"))
        cells = np.zeros((size + 1, size + 1))
        for row, values in summed.select("row", vector_to_array("cells")).collect():
            cells[row] = values
        n = max(cells[size, 1], 1.0)
        loss = cells[size, 0] / n + float(penalty @ weights**2) / 2
        slope = cells[:size, size] / n + penalty * weights
        return loss, slope, cells[:size, :size] / n + np.diag(penalty)

    best = np.zeros(size)
    loss, slope, matrix = at(best)
    passes = 1
    step = None
    while np.max(np.abs(slope)) > tolerance and passes < most_passes:
        if step is None:
            # An intercept of rows without any doubt has no curvature.
            step = np.linalg.solve(matrix + 1e-12 * np.eye(size), slope)
        found = at(best - step)
        passes += 1
        if found[0] <= loss + 1e-12 * abs(loss):
            best, step = best - step, None
            loss, slope, matrix = found
        else:
            step = step / 2
    return LinearModel(
        best[:dimensions], float(best[dimensions]) if intercept else 0.0, passes, float(np.max(np.abs(slope))), loss
    )
