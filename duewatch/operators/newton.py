"""Logistic regressions to a stated precision, several at once from the same scans.

A row is a column number per category and a few scaled numbers, so its product with a vector is a handful of lookups. Newton
steps solve the linear system by conjugate gradients, preconditioned by the diagonal: every product of the Hessian with a
vector is one pass over the rows for all models together, and only vectors of one number per encoded column pass the
driver, however many columns there are. Nothing depends on how the rows are partitioned but the last digits of sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from ..functions import fill_missing_levels
from ..session import fit_tasks, stage
from .encoding import Encoder, join_levels, scaled

STEPS, PRODUCTS = 50, 500
MOST_BYTES = 16 << 20  # of vectors that the driver adds itself


@dataclass(frozen=True)
class Solution:
    """Weights of the encoded columns, of the numbers by name, and the intercept, with the steepest slope left."""

    weights: np.ndarray
    numbers: dict[str, float]
    intercept: float
    slope: float


def design(train: DataFrame, encoder: Encoder, scaling: dict[str, tuple[str, float, float]]) -> DataFrame:
    """``target``, the column number per category (``width`` for an unseen level) and the numbers, ``(column, mean, std)``."""
    looked_up = join_levels(fill_missing_levels(train, encoder.columns), encoder.levels, encoder.columns, "position", "_at")
    at = [F.coalesce(F.col(f"{c}_at"), F.lit(encoder.width)).cast("long").alias(f"at_{c}") for c in encoder.columns]
    numbers = [scaled(*how).alias(f"number_{name}") for name, how in scaling.items()]
    return looked_up.select(F.col("target").cast("double").alias("target"), *at, *numbers)


@dataclass(frozen=True)
class Block:
    """Some rows of one task: labels, ``at[row, category]`` and ``numbers[row, number]`` with a last column of ones."""

    y: np.ndarray
    at: np.ndarray
    numbers: np.ndarray


def block_rows(batches: Iterator[pa.RecordBatch], categories: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``design`` as pickled blocks."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            at = np.stack(columns[1 : 1 + categories], axis=1).astype(np.int32)
            block = Block(columns[0].copy(), at, np.stack([*columns[1 + categories :], np.ones(len(at))], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])


def sums(held: Iterable[Block], weights: np.ndarray, toward: np.ndarray | None, width: int) -> Iterator[np.ndarray]:
    """For each model the slopes and curvatures of the loss per column and the loss; or, given directions, the Hessian's products.

    Vectors hold the encoded columns, a slot for unseen levels, the numbers and the intercept.
    """
    models, size = weights.shape
    out = np.zeros((models, 2 * size + 1))
    for block in held:
        y, at, numbers = block.y, block.at, block.numbers
        cells, categories = at.ravel(), at.shape[1]

        def times(vector: np.ndarray) -> np.ndarray:
            return vector[at].sum(axis=1) + numbers @ vector[width + 1 :]

        def back(values: np.ndarray, squared: bool = False) -> np.ndarray:
            by_cell = np.bincount(cells, np.repeat(values, categories), width + 1)
            return np.concatenate([by_cell, (numbers**2 if squared else numbers).T @ values])

        for k in range(models):
            margin = times(weights[k])
            chance = 0.5 * (1.0 + np.tanh(0.5 * margin))
            curve = chance * (1.0 - chance)
            if toward is None:
                out[k, :size] += back(chance - y)
                out[k, size:-1] += back(curve, squared=True)
                out[k, -1] += (np.logaddexp(0.0, margin) - y * margin).sum()
            else:
                out[k, :size] += back(curve * times(toward[k]))
    yield out


def added(rows: RDD, weights: np.ndarray, toward: np.ndarray | None, width: int) -> np.ndarray:
    """The sums over all tasks; long vectors of many tasks are added on the way to the driver."""
    parts = rows.mapPartitions(partial(sums, weights=weights, toward=toward, width=width))
    long = rows.getNumPartitions() * weights.nbytes > MOST_BYTES
    return parts.treeReduce(np.add) if long else parts.reduce(np.add)


def solve_here(held: Iterator[Block], width: int, **how) -> list[Solution]:
    """All steps in the one task that has all rows."""
    own = list(held)
    return solve(lambda weights, toward: next(sums(own, weights, toward, width)), width=width, **how)


def solve(
    scan: Callable, numbers: Sequence[str], used: Sequence[Sequence[str]], width: int, c: float, tolerance: float
) -> list[Solution]:
    """Minimise ``c * sum(loss) + |w|^2 / 2``, intercept free, for each choice of numbers, until no slope exceeds ``tolerance``."""
    size = width + 1 + len(numbers) + 1
    free = np.ones((len(used), size), bool)
    free[:, width] = False
    for k, names in enumerate(used):
        free[k, width + 1 : -1] = [name in names for name in numbers]
    penalty = np.ones(size)
    penalty[-1] = 0.0
    at = np.zeros((len(used), size))
    step, last = np.zeros_like(at), np.full(len(used), np.inf)
    for _ in range(STEPS):
        found = scan(at, None)
        value = c * found[:, -1] + 0.5 * (penalty * at**2).sum(axis=1)
        worse = value > last + 1e-9 * np.abs(last)
        if worse.any():  # a step too long: go half of it back
            step = np.where(worse[:, None], step / 2, 0.0)
            at = at - step
            continue
        last = value
        slope = np.where(free, c * found[:, :size] + penalty * at, 0.0)
        if np.abs(slope).max() <= tolerance:
            break
        diagonal = np.where(free, c * found[:, size:-1] + penalty, 1.0)
        diagonal[diagonal <= 0.0] = 1.0
        product = lambda v: np.where(
            free, c * scan(at, v)[:, :size] + penalty * v, 0.0
        )
        step = conjugate(product, -slope, diagonal, tolerance)
        at = at + step
    return [
        Solution(at[k, :width], {n: float(at[k, width + 1 + i]) for i, n in enumerate(numbers) if n in used[k]},
                 float(at[k, -1]), float(np.abs(slope[k]).max()))
        for k in range(len(used))
    ]


def conjugate(product, right: np.ndarray, diagonal: np.ndarray, tolerance: float) -> np.ndarray:
    """Solutions of all systems side by side, each to a tenth of what Newton's quadratic convergence can use."""
    size = np.linalg.norm(right, axis=1)
    goal = np.maximum(size * np.minimum(0.1, size / (1.0 + size) * 0.01), tolerance / 10)
    x, residual = np.zeros_like(right), right.copy()
    way = residual / diagonal
    rho = (residual * way).sum(axis=1)
    for _ in range(PRODUCTS):
        going = np.linalg.norm(residual, axis=1) > goal
        if not going.any():
            break
        image = product(way)
        bend = (way * image).sum(axis=1)
        length = np.where(going & (bend > 0), rho / np.where(bend > 0, bend, 1.0), 0.0)[:, None]
        x, residual = x + length * way, residual - length * image
        ready = residual / diagonal
        new = (residual * ready).sum(axis=1)
        way = ready + np.where(rho > 0, new / np.where(rho > 0, rho, 1.0), 0.0)[:, None] * way
        rho = new
    return x


def fit(
    train: DataFrame, encoder: Encoder, scaling: dict[str, tuple[str, float, float]], used: Sequence[Sequence[str]],
    c: float, rows_per_task: int, tolerance: float = 1e-7,
) -> list[Solution]:
    """One model for each choice of numbers; ``scaling`` names every number's column, mean and deviation."""
    table, spark = design(train, encoder, scaling), train.sparkSession
    tasks = fit_tasks(spark, train.count(), rows_per_task)
    packed = stage(table.repartition(tasks), "design").mapInArrow(
        partial(block_rows, categories=len(encoder.columns)), "block binary"
    )
    rows = packed.rdd.map(lambda row: pickle.loads(row.block))
    how = {"numbers": list(scaling), "used": used, "width": encoder.width, "c": c, "tolerance": tolerance}
    if tasks == 1:  # a job for each of hundreds of scans would cost more than they do
        return rows.coalesce(1).mapPartitions(partial(solve_here, **how)).collect()
    rows.persist()
    try:
        return solve(lambda weights, toward: added(rows, weights, toward, encoder.width), **how)
    finally:
        rows.unpersist()
