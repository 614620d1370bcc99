"""Three-class boosted trees with early stopping: each level of a round is one pass that adds up gradients and hessians by class, node,
feature and bin.

The loss is the softmax's; a round grows one tree a class on the same pass. What a pass brings together is as large as the trees' level and the bins,
whatever the rows. The first pass of a round also adds up the loss over the validation rows, so stopping costs no pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import CLASSES
from tickloom.operators.walkforward import TARGETS, Blocks, block_statistics, matrix, numbers, softmax, summed_rows

K = len(CLASSES)


@dataclass
class Tree:
    """A whole binary tree, level by level: per inner node the feature and the bin edge that values up to go left by (feature -1: a leaf
    above the last level), per node the value."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row comes to, after so many levels."""
        at = np.zeros(len(x), dtype=np.int64)
        depth = (len(self.feature) + 1).bit_length() - 1
        for _ in range(depth if levels is None else levels):
            inner = at < len(self.feature)
            here = np.where(inner, at, 0)
            split = inner & (self.feature[here] >= 0)
            left = x[np.arange(len(x)), np.maximum(self.feature[here], 0)] <= self.edge[here]
            at = np.where(split, 2 * at + np.where(left, 1, 2), at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(x)]


@dataclass
class Boosted:
    """Rounds of K trees; median: what stands for missing values; losses: mean log loss on the validation rows, before the first round and after each."""

    names: list[str]
    median: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.median, x)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), K))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of down, neutral and up."""
        return softmax(self.margins(self.filled(x)))


def bin_edges(blocks: Blocks, block: str, median: np.ndarray, bins: int) -> np.ndarray:
    """For each feature bins - 1 edges at equal shares of the block's training rows (equal edges stand for empty bins)."""
    bit = blocks.trains.index(block)
    rows = blocks.table.filter(F.getbit("mask_train", F.lit(bit)) == 1)
    shares = [(k + 1) / bins for k in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col("x")[i], F.lit(float(m))), shares, 10_000).alias(f"e{i}") for i, m in enumerate(median)]).first()
    return np.array([found[f"e{i}"] for i in range(len(median))])


def best_splits(sums: np.ndarray, edges: np.ndarray, penalty: float, least_hessian: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node the feature and bin of largest gain, feature -1 where no split gains. sums: node, feature, bin, (gradient, hessian)."""
    ahead = np.cumsum(sums, axis=2)
    whole = ahead[:, :1, -1:, :]
    left, right = ahead[:, :, :-1], whole - ahead[:, :, :-1]
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = score(left) + score(right) - score(whole)
    apart = np.append(np.diff(edges, axis=1) > 0, np.ones((len(edges), 1), dtype=bool), axis=1)  # of equal edges the last one splits
    allowed = (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian) & apart
    gain = np.where(allowed, gain, -np.inf).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    feature, at = np.divmod(best, sums.shape[2] - 1)
    return np.where(gain[np.arange(len(sums)), best] > 1e-12, feature, -1), at


def fit_boosted(blocks: Blocks, block: str, depth: int = 3, most: int = 120, rate: float = 0.05, bins: int = 32, patience: int | None = 10, penalty: float = 1.0, least_hessian: float = 1.0) -> Boosted:
    """Trees of one training block, stopped when the log loss of the rows that test it hasn't fallen for `patience` rounds, and cut back to the best;
    patience None: all `most` rounds, as for a refit with a number found before."""
    bit, features = blocks.trains.index(block), len(blocks.names)
    statistics = block_statistics(blocks)[block]
    if not statistics["classes"].all():
        raise ValueError(f"block {block} lacks a class to train on")
    model = Boosted(list(blocks.names), statistics["prepare"][0])
    edges = bin_edges(blocks, block, model.median, bins)

    def level_sums(trees: list[Tree], level: int) -> tuple[np.ndarray, float, float]:
        """Sums by class, node of the level, feature and bin, and the loss and number of the validation rows (at level 0)."""
        nodes, first, so_far = 1 << level, (1 << level) - 1, Boosted(model.names, model.median, list(model.rounds))

        def part(batches: Iterator[pa.RecordBatch], totals: np.ndarray) -> None:
            found = totals[:-2].reshape(K, nodes, features, bins, 2)
            for batch in batches:
                x, y = so_far.filled(matrix(batch, features)), numbers(batch, "target_class_id").astype(int)
                train, test = (numbers(batch, m) >> bit & 1 for m in ("mask_train", "mask_test"))
                if level == 0 and test.any():
                    mine = np.flatnonzero(test)
                    p = softmax(so_far.margins(x[mine]))[np.arange(len(mine)), y[mine]]
                    totals[-2] -= np.log(np.maximum(p, 1e-15)).sum()
                    totals[-1] += len(mine)
                mine = np.flatnonzero(train)
                x, y = x[mine], y[mine]
                p = softmax(so_far.margins(x))
                binned = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]) if len(x) else np.zeros((0, features), dtype=int)
                for k in range(K):
                    at = trees[k].nodes(x, level) - first
                    inside = np.flatnonzero(at >= 0)  # rows in a leaf above stay there
                    weights = np.stack([p[inside, k] - (y[inside] == k), np.maximum(2 * p[inside, k] * (1 - p[inside, k]), 1e-16)])
                    for i in range(features):
                        place = at[inside] * bins + binned[inside, i]
                        for j in range(2):
                            found[k, :, i, :, j] += np.bincount(place, weights[j], nodes * bins).reshape(nodes, bins)

        sums = summed_rows(blocks, K * nodes * features * bins * 2 + 2, part)
        return sums[:-2].reshape(K, nodes, features, bins, 2), sums[-2], sums[-1]

    best = 0
    for _ in range(most + 1):
        whole = (1 << depth + 1) - 1
        trees = [Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1), np.zeros(whole)) for _ in range(K)]
        for level in range(depth):
            sums, loss, n = level_sums(trees, level)
            if level == 0:
                if patience is not None and not n:
                    raise ValueError(f"no rows validate {block}")
                model.losses.append(loss / n if n else float("nan"))
                best = len(model.losses) - 1 if model.losses[-1] < model.losses[best] else best
                if len(model.rounds) == most or patience is not None and len(model.losses) - 1 - best >= patience:
                    model.rounds = model.rounds[:best] if patience is not None else model.rounds
                    return model
            first = (1 << level) - 1
            for k, tree in enumerate(trees):
                feature, at = best_splits(sums[k], edges, penalty, least_hessian)
                total = sums[k].sum(axis=2)[:, 0]  # of a node: gradient, hessian
                for node in range(1 << level):
                    here = first + node
                    parent = (here - 1) // 2
                    if level and tree.feature[parent] < 0:
                        continue
                    tree.value[here] = -rate * total[node, 0] / (total[node, 1] + penalty)
                    if feature[node] >= 0:
                        ahead = sums[k][node, feature[node], : at[node] + 1].sum(axis=0)
                        tree.feature[here], tree.edge[here] = feature[node], edges[feature[node], at[node]]
                        for child, s in ((2 * here + 1, ahead), (2 * here + 2, total[node] - ahead)):
                            tree.value[child] = -rate * s[0] / (s[1] + penalty)
        model.rounds.append(trees)
    return model


def score_boosted(blocks: Blocks, block: str, model: Boosted) -> DataFrame:
    """Keys, targets and probabilities of the rows that test the block."""
    bit, features, columns = blocks.trains.index(block), len(blocks.names), [*blocks.keys, *TARGETS, *[f"p_{c}" for c in CLASSES]]
    schema = blocks.table.select(*blocks.keys, *TARGETS, *[F.lit(0.0).alias(f"p_{c}") for c in CLASSES]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.predict(matrix(batch, features))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns[: -len(CLASSES)]], *[pa.array(p[:, k]) for k in range(K)]], names=columns)

    rows = blocks.table.filter(F.getbit("mask_test", F.lit(bit)) == 1).select("x", *blocks.keys, *TARGETS).mapInArrow(run, schema)
    return rows.withColumn("target_class", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("target_class_id").cast("int") + 1))
