"""Gradient-boosted regression trees as MLlib's classifier grows them, from sums over packed rows.

The trees are those of ``GBTClassifier``: log loss, variance as impurity, the same candidate borders, ties to the first
feature and border. MLlib holds rows as objects and walks every one through the tree for each level. Here a row is a byte per
feature, a label, a margin and a residual, and a block of them goes through a level in a few passes over whole arrays.

*Sums.* A level needs the count and the sum of the residuals per (node, feature, bin). Features with few bins are counted
together, as one number, and parted afterwards. Only the smaller child of a split is scanned; the larger one is what is left
of its parent. Residuals are whole numbers of parts of one, so sums are exact and splits, gains and predictions do not depend
on how rows lie in tasks.

*Tasks.* Up to ``ROWS_HERE`` rows are one task's, which grows all trees by itself: a job costs about a tenth of a second, and
there would be one for each of thousands of levels. More rows take that job for each level, in as many tasks as run at once.
The driver gets tables of a level's size. Margins are written anew every few trees; a lost executor reads them again.

*Borders.* MLlib reads about 10,000 rows for them, which ones depends on the partitions. Here all rows count, by the same rule.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import fit_tasks, stage, staged_path
from .forest import Forest

UNIT = 1 << 26  # residuals are summed in these parts of one
ROWS_HERE = 1 << 23  # of a sample that one task grows all trees of
ROWS_PER_BLOCK = 1 << 17
ROWS_DEALT = 1 << 12  # go to a task together
JOINT_BINS = 1 << 11  # of features counted together
MOST_TABLES = 64  # tasks whose sums the driver adds itself
MOST_LOADS = 20
ROWS_PER_SCORE = 1 << 16
LEAST_GAIN = 1e-12  # of the mean square; less is rounding

COUNTS = "feature int, value double, n long"
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


# --------------------------------------------------------------------------- borders


def value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(feature, value, n)`` of each batch; the first column is the label."""
    for batch in batches:
        for feature in range(batch.num_columns - 1):
            values, n = np.unique(known(batch, feature + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), feature, np.int32)), pa.array(values), pa.array(n.astype(np.int64))],
                ["feature", "value", "n"],
            )


def known(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    found = values.to_numpy(zero_copy_only=False)
    if values.null_count or np.isnan(found).any():
        raise ValueError(f"missing values in {batch.schema.names[column]}")
    return found


def borders_of(counts: Iterator[tuple[float, int]], rows: int, most: int) -> list[float]:
    """MLlib's rule: all middles between neighbouring values if there are at most ``most``, else those nearest to equal shares."""
    every, chosen = [], []
    stride = rows / (most + 1)
    target, upto, last = stride, 0, None
    for value, n in counts:
        if last is not None:
            middle = (last + value) / 2.0
            if len(every) <= most:
                every.append(middle)
            if abs(upto - target) < abs(upto + n - target):
                chosen.append(middle)
                target += stride
        last, upto = value, upto + n
    return every if len(every) <= most else chosen


def find_borders(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """``(feature, borders)`` from value counts in order; nothing but the last value is held."""
    cells = (cell for batch in batches for cell in zip(*(batch.column(k).to_pylist() for k in range(3))))
    for feature, own in groupby(cells, key=lambda cell: cell[0]):
        found = borders_of(((value, n) for _, value, n in own), rows, most)
        columns = [pa.array([feature], pa.int32()), pa.array([found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "borders"])


def candidate_borders(features: DataFrame, rows: int, bins: int) -> list[list[float]]:
    """At most ``bins - 1`` borders for each feature, all columns but the first."""
    counts = features.mapInArrow(value_counts, COUNTS).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ordered = counts.repartition("feature").sortWithinPartitions("feature", "value")
    found = ordered.mapInArrow(partial(find_borders, rows=rows, most=min(bins, rows) - 1), "feature int, borders array<double>")
    by_feature = {row.feature: row.borders for row in found.collect()}
    return [by_feature[k] for k in range(len(features.columns) - 1)]


# --------------------------------------------------------------------------- rows


def packed(batches: Iterator[pa.RecordBatch], borders: Sequence[Sequence[float]]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: the label, then for each feature the number of borders below its value, a byte each."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_DEALT):
            part = batch.slice(low, ROWS_DEALT)
            late = known(part, 0)
            if not np.isin(late, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            bins = [np.searchsorted(at, known(part, k + 1)) for k, at in enumerate(borders)]
            table = np.stack([late, *bins]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["rows"])


def together(widths: Sequence[int], most: int = JOINT_BINS) -> list[list[int]]:
    """Features that are counted as one: the product of their numbers of bins is bounded."""
    groups: list[list[int]] = []
    for feature in sorted(range(len(widths)), key=lambda k: -widths[k]):
        for group in groups:
            if np.prod([widths[k] for k in (*group, feature)]) <= most:
                group.append(feature)
                break
        else:
            groups.append([feature])
    return groups


class Block:
    """Some rows of one task: signs of the labels, margins, residuals in whole units, ``bins[feature]`` and bins of groups as one."""

    def __init__(self, sign: np.ndarray, margin: np.ndarray, residual: np.ndarray, bins: np.ndarray, joint: Sequence[np.ndarray]):
        self.sign, self.margin, self.residual, self.bins, self.joint = sign, margin, residual, bins, joint

    def below(self, code: np.ndarray, splits: Sequence[tuple[int, int, int]]) -> np.ndarray:
        """Codes one level down: a row above the border of its node's ``(code, feature, border)`` gets the odd one of two."""
        above = np.zeros(len(code), bool)
        for own, feature, border in splits:
            above |= (code == own) & (self.bins[feature] > border)
        return code * 2 + above

    def squares(self, code: np.ndarray, codes: int) -> np.ndarray:
        return np.bincount(code, self.residual.astype(np.float64) ** 2, codes)

    def raised(self, change: np.ndarray) -> Block:
        """The rows with something added to their margins."""
        margin = self.margin + change
        with np.errstate(over="ignore"):
            scale = np.exp(margin * (self.sign * 2.0))
        residual = np.rint((4.0 * UNIT) * self.sign / (1.0 + scale)).astype(np.int32)
        return Block(self.sign, margin, residual, self.bins, self.joint)


def blocks(tables: Iterable[bytes], widths: Sequence[int]) -> Iterator[Block]:
    """Rows of ``packed`` as blocks before the first tree, whose residuals are the signs."""
    held, rows = [], 0
    for table in tables:
        held.append(np.frombuffer(table, np.uint8).reshape(len(widths) + 1, -1))
        rows += held[-1].shape[1]
        if rows >= ROWS_PER_BLOCK:
            yield block_of(np.concatenate(held, axis=1), widths)
            held, rows = [], 0
    if held:
        yield block_of(np.concatenate(held, axis=1), widths)


def block_of(table: np.ndarray, widths: Sequence[int]) -> Block:
    sign, joint = table[0].astype(np.int8) * 2 - 1, []
    for group in together(widths):
        at = np.zeros(len(sign), np.uint16)
        for feature in group:
            at *= np.uint16(widths[feature])
            at += table[1 + feature]
        joint.append(at)
    return Block(sign, np.zeros(len(sign)), sign.astype(np.int32) * UNIT, table[1:], joint)


# --------------------------------------------------------------------------- sums


class Sums:
    """Counts and sums of residuals ``[2, slot, feature, bin]`` of the rows whose nodes have a slot."""

    def __init__(self, widths: Sequence[int], slots: np.ndarray):
        self.widths, self.slots, self.used = widths, slots, int(slots.max()) + 1
        self.groups = together(widths)
        self.shapes = [[self.used, *(widths[k] for k in group)] for group in self.groups]
        self.cells = [np.zeros((2, int(np.prod(shape)))) for shape in self.shapes]

    def add(self, block: Block, code: np.ndarray | None) -> None:
        at = slot = None
        if code is not None:
            slot = self.slots[code]
            at = np.flatnonzero(slot >= 0)
            slot = slot[at].astype(np.intp)
        residual = (block.residual if at is None else block.residual[at]).astype(np.float64)
        for sums, joint in zip(self.cells, block.joint):
            cell = (joint if at is None else joint[at]).astype(np.intp)
            if self.used > 1:
                cell += slot * (sums.shape[1] // self.used)
            sums[0] += np.bincount(cell, None, sums.shape[1])
            sums[1] += np.bincount(cell, residual, sums.shape[1])

    def table(self) -> np.ndarray:
        found = np.zeros((2, self.used, len(self.widths), max(self.widths)), np.int64)
        for group, shape, sums in zip(self.groups, self.shapes, self.cells):
            cells = sums.reshape(2, *shape)
            for axis, feature in enumerate(group):
                others = tuple(2 + x for x in range(len(group)) if x != axis)
                found[:, :, feature, : self.widths[feature]] = cells.sum(axis=others)
        return found


def code_kind(depth: int) -> type:
    return np.uint8 if depth <= 8 else np.uint16 if depth <= 16 else np.uint32


def codes(block: Block, levels: Sequence[Sequence[tuple[int, int, int]]], depth: int) -> np.ndarray:
    code = np.zeros(len(block.sign), code_kind(depth))
    for splits in levels:
        code = block.below(code, splits)
    return code


class Here:
    """The rows of a sample in one task."""

    def __init__(self, held: Iterator[Block], widths: Sequence[int], depth: int):
        self.blocks, self.widths, self.depth = list(held), widths, depth
        self.restart()

    def restart(self) -> None:
        self.codes, self.deep = [codes(block, (), self.depth) for block in self.blocks], 0

    def descend(self, levels: Sequence) -> Iterator[tuple[int, Block, np.ndarray]]:
        for k, block in enumerate(self.blocks):
            for splits in levels[self.deep :]:
                self.codes[k] = block.below(self.codes[k], splits)
            yield k, block, self.codes[k]
        self.deep = len(levels)

    def sums(self, levels: Sequence, slots: np.ndarray) -> np.ndarray:
        """Sums of the nodes of a level that have a slot, by the splits of all levels above."""
        found = Sums(self.widths, slots)
        for _, block, code in self.descend(levels):
            found.add(block, code if levels else None)
        return found.table()

    def raised(self, levels: Sequence, values: np.ndarray) -> np.ndarray:
        """Add a tree to the margins; the squared residuals it had, by code."""
        squares = np.zeros(len(values))
        for k, block, code in self.descend(levels):
            squares += block.squares(code, len(values))
            self.blocks[k] = block.raised(values[code])
        self.restart()
        return squares


class Kept:
    """The rows of one task in files of its executor, so that a job need not send them to Python again.

    Only a cache: a task that finds no files, or not those of the tree it asks for, says so, and the rows are written again
    from the shared folder and the trees so far. Margins and residuals are named by the number of trees in them and written
    aside first, so a task may run twice.
    """

    def __init__(self, fit: str, task: int):
        self.path = f"{os.environ.get('SPARK_LOCAL_DIRS', tempfile.gettempdir()).split(',')[0]}/duewatch-{fit}-{task}"

    @classmethod
    def write(cls, fit: str, task: int, held: Iterator[Block], trees: Sequence[tuple], depth: int) -> Kept:
        self = cls(fit, task)
        shutil.rmtree(self.path, ignore_errors=True)
        os.makedirs(self.path)
        table = list(held)
        for k, block in enumerate(table):
            change = np.zeros(len(block.sign))
            for levels, values in trees:
                change += values[codes(block, levels, depth)]
            if trees:
                table[k] = block.raised(change)
        if table:
            self.put("sign", np.concatenate([block.sign for block in table]))
            self.put("bins", np.concatenate([block.bins for block in table], axis=1))
            self.put("joint", np.stack([np.concatenate(parts) for parts in zip(*(block.joint for block in table))]))
        self.put_margins(len(trees), table)
        return self

    def put(self, name: str, values: np.ndarray) -> None:
        aside = f"{self.path}/aside-{os.getpid()}.npy"
        np.save(aside, values)
        os.rename(aside, f"{self.path}/{name}.npy")

    def put_margins(self, tree: int, table: Sequence[Block]) -> None:
        self.put(f"residual-{tree}", np.concatenate([np.empty(0, np.int32), *(block.residual for block in table)]))
        self.put(f"margin-{tree}", np.concatenate([np.empty(0), *(block.margin for block in table)]))

    def get(self, name: str) -> np.ndarray:
        return np.load(f"{self.path}/{name}.npy", mmap_mode="r")

    def blocks(self, tree: int) -> Iterator[Block]:
        """Raises ``FileNotFoundError`` if these rows are not here."""
        margin = np.load(f"{self.path}/margin-{tree}.npy", mmap_mode="r" if os.path.getsize(f"{self.path}/margin-{tree}.npy") > 128 else None)
        if not len(margin):
            return
        residual, sign, bins, joint = (self.get(name) for name in (f"residual-{tree}", "sign", "bins", "joint"))
        for low in range(0, len(sign), ROWS_PER_BLOCK):
            own = slice(low, low + ROWS_PER_BLOCK)
            yield Block(sign[own], margin[own], residual[own], bins[:, own], joint[:, own])

    def raise_to(self, tree: int, levels: Sequence, values: np.ndarray, depth: int) -> np.ndarray:
        """Write the margins with one tree more; the squared residuals it had, by code."""
        squares, table = np.zeros(len(values)), []
        for block in self.blocks(tree - 1):
            code = codes(block, levels, depth)
            squares += block.squares(code, len(values))
            table.append(block.raised(values[code]))
        self.put_margins(tree, table)
        for name in (f"residual-{tree - 2}", f"margin-{tree - 2}"):
            if os.path.exists(f"{self.path}/{name}.npy"):
                os.remove(f"{self.path}/{name}.npy")
        return squares


def keep(task: int, tables: Iterator, fit: str, widths: Sequence[int], trees: Sequence[tuple], depth: int) -> Iterator[int]:
    Kept.write(fit, task, blocks((row.rows for row in tables), widths), trees, depth)
    yield task


def kept_sums(
    task: int, handles: Iterator[int], fit: str, tree: int, last: tuple | None, levels: Sequence, slots: np.ndarray, widths: Sequence[int], depth: int
) -> Iterator[tuple | None]:
    """One task's sums, after adding the last tree to its margins; nothing if its rows are not in this executor."""
    kept, found, squares = Kept(fit, task), Sums(widths, slots), 0.0
    try:
        if last is not None:
            squares = kept.raise_to(tree, *last, depth)
        for block in kept.blocks(tree):
            found.add(block, codes(block, levels, depth) if levels else None)
        yield found.table(), squares
    except FileNotFoundError:
        yield None
    for _ in handles:  # read late: the executor sends it while the sums are made
        pass


def forget(task: int, handles: Iterator[int], fit: str) -> Iterator[int]:
    shutil.rmtree(Kept(fit, task).path, ignore_errors=True)
    yield from handles


def both(a: tuple | None, b: tuple | None) -> tuple | None:
    return None if a is None or b is None else (a[0] + b[0], a[1] + b[1])


class Spread:
    """The rows of a sample in many tasks, a job for each level."""

    def __init__(self, tables: RDD, widths: Sequence[int], depth: int):
        self.tables, self.widths, self.depth = tables, widths, depth
        self.fit, self.trees, self.last, self.squares, self.loads = uuid.uuid4().hex, [], None, None, 0
        self.load()

    def load(self) -> None:
        """Write all rows to the executors, where the handles are cached and later tasks run."""
        self.loads += 1
        if self.loads > MOST_LOADS:
            raise Wandering(f"tasks ran away from their rows {MOST_LOADS} times; is spark.locality.wait 0?")
        if self.loads > 1:
            self.close()
        how = {"fit": f"{self.fit}-{self.loads}", "widths": self.widths, "trees": self.trees, "depth": self.depth}
        self.handles = self.tables.mapPartitionsWithIndex(partial(keep, **how)).persist()
        self.handles.count()

    def sums(self, levels: Sequence, slots: np.ndarray) -> np.ndarray:
        while True:
            how = {"fit": f"{self.fit}-{self.loads}", "tree": len(self.trees), "last": None if levels else self.last}
            how |= {"levels": levels, "slots": slots, "widths": self.widths, "depth": self.depth}
            parts = self.handles.mapPartitionsWithIndex(partial(kept_sums, **how))
            found = parts.treeReduce(both) if parts.getNumPartitions() > MOST_TABLES else parts.reduce(both)
            if found is not None:
                break
            if how["last"]:  # its squares come with a step from the tree before
                self.trees.pop()
                self.load()
                self.trees.append(self.last)
            else:
                self.load()
        if not levels:
            self.squares = found[1]
        return found[0]

    def raised(self, levels: Sequence, values: np.ndarray) -> None:
        self.last = levels, values
        self.trees.append(self.last)

    def close(self) -> None:
        self.handles.mapPartitionsWithIndex(partial(forget, fit=f"{self.fit}-{self.loads}")).count()
        self.handles.unpersist()


class Wandering(RuntimeError):
    """Tasks do not run where their rows are."""


# --------------------------------------------------------------------------- trees


class Node:
    """A node over all rows: count and sum, its place, and the split ``(feature, border)`` if there is one."""

    def __init__(self, n: int, total: int, code: int):
        self.n, self.total, self.code = n, total, code
        self.squares, self.gain, self.split, self.children = 0.0, -1.0, None, ()

    @property
    def prediction(self) -> float:
        return self.total / UNIT / self.n


def best_splits(sums: np.ndarray, widths: Sequence[int]) -> list[tuple[float, int, int, int, int] | None]:
    """For each node of ``sums[2, node, feature, bin]`` the best ``(gain, feature, border, rows below, their sum)``, if any gains."""
    whole = np.cumsum(sums, axis=3)
    low_n, low = whole.astype(np.float64)
    n, total = low_n[:, :1, -1:], low[:, :1, -1:]
    high_n = n - low_n
    allowed = (np.arange(sums.shape[3]) < np.array(widths)[:, None] - 1) & (low_n > 0) & (high_n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = low**2 / low_n + (total - low) ** 2 / high_n
        gains = np.where(allowed, (parts - total**2 / n) / n, -np.inf)
    best = []
    for node, cells in enumerate(gains):
        feature, border = divmod(int(cells.argmax()), cells.shape[1])
        gain, at = float(cells[feature, border]), (node, feature, border)
        wins = gain > 0 and gain > LEAST_GAIN * float(parts[at]) / float(n[node, 0, 0])
        best.append((gain / UNIT**2, feature, border, int(whole[0][at]), int(whole[1][at])) if wins else None)
    return best


def grow(sums_of: Callable, widths: Sequence[int], depth: int, weight: float) -> tuple[Node, list[Node], list, np.ndarray]:
    """One tree: its root, its leaves, the splits by level, and what it adds to a margin by the code of the last level."""
    sums = sums_of([], np.zeros(1, np.int16))
    root = Node(*(int(x) for x in sums[:, 0, 0].sum(axis=1)), 0)
    level, leaves, levels = [root], [], []
    while level and len(levels) < depth:
        splits, below, parents, small = [], [], [], []
        for k, (node, best) in enumerate(zip(level, best_splits(sums, widths))):
            if best is None:
                leaves.append((node, len(levels)))
                continue
            node.gain, *node.split, n, total = best
            splits.append((node.code, *node.split))
            node.children = (Node(n, total, 2 * node.code), Node(node.n - n, node.total - total, 2 * node.code + 1))
            below += node.children
            parents.append(k)
            small.append(int(n > node.n - n))
        levels.append(splits)
        level = below
        if level and len(levels) < depth:
            slots = np.full(1 << len(levels), -1, np.int16 if depth < 16 else np.int32)
            for slot, side in enumerate(small):
                slots[level[2 * slot + side].code] = slot
            scanned = sums_of(levels, slots)
            rest = sums[:, parents] - scanned
            sums = np.stack([(scanned, rest)[side != at][:, k] for k, at in enumerate(small) for side in (0, 1)], axis=1)
    leaves += [(node, len(levels)) for node in level]
    values = np.zeros(1 << len(levels))
    for node, deep in leaves:  # rows of an early leaf went on to the even ones
        node.code <<= len(levels) - deep
        values[node.code] = weight * node.prediction
    return root, [node for node, _ in leaves], levels, values


def finish(node: Node) -> None:
    """Squares of inner nodes from their leaves; a split whose leaves say the same is taken back, as MLlib does."""
    for child in node.children:
        finish(child)
    if node.children:
        low, high = node.children
        node.squares = low.squares + high.squares
        if not low.children and not high.children and low.prediction == high.prediction:
            node.gain, node.split, node.children = -1.0, None, ()


def node_rows(root: Node, borders: Sequence[Sequence[float]]) -> list[tuple]:
    """Nodes in MLlib's order and fields: a node, all below its lower child, all below its higher one."""
    table: list[tuple] = []

    def walk(node: Node) -> int:
        own, squares, total = len(table), node.squares / UNIT**2, node.total / UNIT
        table.append(())
        children = [walk(child) for child in node.children] or [-1, -1]
        split = (node.split[0], [float(borders[node.split[0]][node.split[1]])], -1) if node.split else (-1, [], -1)
        stats = [float(node.n), total, squares]
        impurity = (squares - total**2 / node.n) / node.n
        table[own] = (own, node.prediction, impurity, stats, node.n, node.gain, *children, split)
        return own

    walk(root)
    return table


def boosted(rows: Here | Spread, borders: Sequence[Sequence[float]], trees: int, step: float) -> Iterator[list[tuple]]:
    """The nodes of each tree. The first one counts in full, as in MLlib."""
    last = None

    def done(root: Node, leaves: list[Node], squares: np.ndarray) -> list[tuple]:
        for leaf in leaves:
            leaf.squares = float(squares[leaf.code])
        finish(root)
        return node_rows(root, borders)

    for tree in range(trees):
        root, leaves, levels, values = grow(rows.sums, rows.widths, rows.depth, step if tree else 1.0)
        if last is not None:
            yield done(*last, rows.squares)
        squares, last = rows.raised(levels, values), None
        if squares is None:  # known with the sums of the next tree
            last = root, leaves
        else:
            yield done(root, leaves, squares)
    if last is not None:
        rows.sums([], np.zeros(1, np.int16))
        yield done(*last, rows.squares)


def boosted_here(tables: Iterator, widths: Sequence[int], depth: int, **how) -> Iterator[list[tuple]]:
    return boosted(Here(blocks((row.rows for row in tables), widths), widths, depth), **how)


def fit(features: DataFrame, trees: int, depth: int, step: float, bins: int, rows_per_task: int) -> list[list[tuple]]:
    """The nodes of each tree, as rows of ``NODES``, for a table of a label and double features, which is scanned a few times."""
    spark = features.sparkSession
    rows = features.count()
    if not rows:
        raise ValueError("the training sample is empty")
    borders = candidate_borders(features, rows, bins)
    widths = [len(at) + 1 for at in borders]
    tasks, how = fit_tasks(spark, rows, rows_per_task), {"borders": borders, "trees": trees, "step": step}
    dealt = stage(features.mapInArrow(partial(packed, borders=borders), "rows binary").repartition(tasks), "packed-rows").rdd
    if rows > ROWS_HERE:
        spread = None
        try:
            spread = Spread(dealt.coalesce(tasks), widths, depth)
            return list(boosted(spread, **how))
        except Wandering as why:
            warnings.warn(f"{why} The fit goes on in one task.")
        finally:
            if spread is not None:
                spread.close()
    return dealt.coalesce(1).mapPartitions(partial(boosted_here, widths=widths, depth=depth, **how)).collect()


# --------------------------------------------------------------------------- scoring


def by_level(nodes: dict[int, tuple], places: dict[str, int], borders: Sequence[np.ndarray]) -> tuple[list, np.ndarray]:
    """Splits by level and values by code of a tree ``node -> (feature, border, low, high, value)`` with node 0 as its root."""
    levels, leaves, level = [], [], [(0, 0)]
    while any(nodes[node][0] is not None for node, _ in level):
        splits, below = [], []
        for node, code in level:
            feature, border, low, high, _ = nodes[node]
            if feature is None:
                leaves.append((node, code, len(levels)))
                continue
            place = places[feature]
            splits.append((code, place, int(np.searchsorted(borders[place], border))))
            below += [(low, 2 * code), (high, 2 * code + 1)]
        levels.append(splits)
        level = below
    leaves += [(node, code, len(levels)) for node, code in level]
    values = np.zeros(1 << len(levels))
    for node, code, deep in leaves:
        values[code << (len(levels) - deep)] = nodes[node][4]
    return levels, values


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` or a few more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def margins(
    batches: Iterator[pa.RecordBatch], trees: Sequence[tuple], borders: Sequence[np.ndarray], start: float
) -> Iterator[pa.RecordBatch]:
    """The margin of each row in place of its features, the last columns."""
    kind = np.uint8 if max(map(len, borders)) < 256 else np.uint32
    for batch in in_blocks(batches, ROWS_PER_SCORE):
        kept = batch.num_columns - len(borders)
        bins = [np.searchsorted(at, known(batch, kept + k)).astype(kind) for k, at in enumerate(borders)]
        block = Block(np.empty(batch.num_rows), None, None, bins, ())
        margin = np.full(batch.num_rows, float(start))
        for levels, values in trees:
            margin += values[codes(block, levels, len(levels))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(margin)], [*batch.schema.names[:kept], "_margin"])


def margin_of(forest: Forest, df: DataFrame, names: Sequence[str], *keep) -> DataFrame:
    """``keep`` and ``_margin`` for every row. A missing feature is an error.

    Rows are looked up block by block; hundreds of deep trees as one expression take longer to compile than to run.
    """
    nodes: dict[int, dict[int, tuple]] = {}
    for tree, node, *what in forest.nodes.select("tree", "node", "feature", "border", "low", "high", "value").collect():
        nodes.setdefault(tree, {})[node] = what
    found = [{what[1] for own in nodes.values() for what in own.values() if what[0] == name} for name in names]
    borders = [np.array(sorted(at)) for at in found]
    places = {name: k for k, name in enumerate(names)}
    trees = [by_level(nodes[tree], places, borders) for tree in sorted(nodes)]
    ready = df.select(*keep, *(F.col(name).cast("double").alias(f"_{name}") for name in names))
    kept = ready.schema[: len(ready.columns) - len(names)]
    task = partial(margins, trees=trees, borders=borders, start=forest.start)
    return ready.mapInArrow(task, T.StructType([*kept, T.StructField("_margin", T.DoubleType())]))


# --------------------------------------------------------------------------- store


def write_model(spark: SparkSession, path: str, trees: Sequence[Sequence[tuple]], estimator: GBTClassifier, features: int) -> None:
    """The folder that MLlib keeps a ``GBTClassificationModel`` of these trees in."""
    given = {param.name: value for param, value in estimator._paramMap.items()}
    defaults = {param.name: value for param, value in estimator._defaultParamMap.items()}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    model = "org.apache.spark.ml.classification.GBTClassificationModel"
    whole = {"class": model, **about, "uid": estimator.uid, "paramMap": given, "defaultParamMap": defaults}
    tree_params = {name: given[name] for name in ("featuresCol", "labelCol", "maxDepth", "seed")}
    tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "paramMap": tree_params, "defaultParamMap": {}}
    weights = [
        (k, json.dumps(tree | {"uid": f"{estimator.uid}_{k}"}), float(given["stepSize"]) if k else 1.0) for k in range(len(trees))
    ]
    nodes = [(k, node) for k, table in enumerate(trees) for node in table]
    text = json.dumps(whole | {"numFeatures": features, "numTrees": len(trees)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")


def train(features: DataFrame, estimator: GBTClassifier, rows_per_task: int) -> str:
    """The folder of what ``estimator`` would fit to the vectors of all columns but the first, the label."""
    spark, path = features.sparkSession, staged_path(features.sparkSession, "boosted")
    get = estimator.getOrDefault
    trees = fit(features, get("maxIter"), get("maxDepth"), get("stepSize"), get("maxBins"), rows_per_task)
    write_model(spark, path, trees, estimator, len(features.columns) - 1)
    return path
