"""Exact top-k by inner product with a pivot table: distances to pivots, computed once, bound every candidate's distance from
below; candidates are evaluated in the order of their bounds until the next bound rules out all that are left."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, numbered
from tickloom.llm.vectors import Best, finite, power_above, search

SLACK = 1e-9
EXACT = 53


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: doubles where all are below 2**53 in size, else Python integers."""
    if power_above(x) + scale.bit_length() <= EXACT:
        return np.floor(x * float(scale))
    out = np.empty(x.shape, dtype=object)
    for at in np.ndindex(x.shape):
        over, under = float(x[at]).as_integer_ratio()
        out[at] = over * scale // under
    return out


def unit(x: np.ndarray, power: int) -> np.ndarray:
    """Whole numbers divided by 2**power, as doubles."""
    if x.dtype == object:
        return np.array([math.ldexp(*_mantissa(v, power)) for v in x.ravel()], dtype=np.float64).reshape(x.shape)
    return np.ldexp(x, -power)


def _mantissa(v: int, power: int) -> tuple[float, int]:
    drop = max(0, v.bit_length() - 60)
    return float(v >> drop), drop - power


def bits(x: np.ndarray) -> int:
    """The least n such that all whole numbers are at most 2**n in size."""
    return max((abs(v).bit_length() for v in x.ravel()), default=0) if x.dtype == object else power_above(x)


class PivotTable:
    """A shard's integer vectors, its pivots (each the farthest from those before) and all distances between them. Distances are
    of vectors divided by a power of two above all components, so none overflows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, scale: int, pivots: int):
        self.ids, self.rows, self.scale = ids, rows, scale
        self.x = whole(matrix, scale)
        self.power = bits(self.x)
        small = unit(self.x, self.power)
        square = np.einsum("ij,ij->i", small, small)
        self.top = float(square.max(initial=0.0))
        lifted = np.column_stack([small, np.sqrt(np.maximum(0.0, self.top - square))])
        chosen, nearest = [int(np.argmax(square))], np.full(len(ids), np.inf)
        columns = []
        while True:
            columns.append(np.linalg.norm(lifted - lifted[chosen[-1]], axis=1))
            nearest = np.minimum(nearest, columns[-1])
            if len(chosen) == min(pivots, len(ids)) or not nearest.max(initial=0.0):
                break
            chosen.append(int(np.argmax(nearest)))
        self.pivots, self.table = lifted[chosen], np.column_stack(columns)

    def find(self, own: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        best = Best(len(vectors), k, np.int64)
        for i in range(len(vectors)):
            q = whole(vectors[i : i + 1], self.scale)[0]
            power = bits(q)
            small = unit(q, power)
            norm = float(small @ small)
            to_pivots = np.linalg.norm(self.pivots - np.append(small, 0.0), axis=1)
            bound = np.abs(self.table - to_pivots).max(axis=1)
            order = np.argsort(bound, kind="stable")
            at, step, reach = 0, 64, np.inf
            while at < len(order) and bound[order[at]] <= reach * (1 + SLACK) + SLACK:
                part = order[at : at + step]
                best.add(i, exact_products(self.x[part], q), self.ids[part], self.rows[part], own[i])
                if best.least[i] is not None:
                    least = math.ldexp(*_mantissa(int(best.least[i]), self.power + power))
                    reach = math.sqrt(max(0.0, norm + self.top - 2 * least))
                at, step = at + step, step * 2
        return best.rows()


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where no sum can leave 53 bits, in int64 where none can leave 63, else in integers of
    any size."""
    most = bits(x) + bits(q) + max(1, len(q)).bit_length()
    if most <= EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most <= 62:
        return (x.astype(np.int64) * q.astype(np.int64)).sum(axis=1)
    mine = [int(v) for v in q]
    out = np.empty(len(x), dtype=object)
    for i, row in enumerate(x):
        out[i] = sum(int(a) * b for a, b in zip(row, mine, strict=True))
    return out


def top_products(rows: DataFrame, query_where: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, pivots: int = 24, shard_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that query_where picks the k other rows of largest integer inner product,
    exactly; components are floor(scale * x).

    rows: vec_id, embedding; other columns aren't used. Ties go to the smaller vec_id, null ids first. Vectors that are
    null or hold null or non-finite components take no part; all others do, of any size: components and scores are whole
    numbers without bound, and the job fails only if a score to return is no long. Zero and empty vectors score 0;
    vectors of another length than the query's are no candidates; fewer than k candidates are all returned. Repeated rows
    are candidates of one another. An empty table gives no rows.
    """
    plain = numbered(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")))
    usable = materialize(plain.filter(finite("vec")))
    return search(usable, usable.filter(query_where), k, shard_rows, lambda i, r, m: PivotTable(i, r, m, scale, pivots), lambda t, own, q, n: t.find(own, q, n), "long")
