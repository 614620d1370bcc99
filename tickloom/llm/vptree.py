"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the smallest distance and the
triangle inequality holds. A branch is pruned if its distance bound, times a factor, exceeds the query's k-th distance;
factor 1 is exact search, a larger one prunes more and may miss rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, numbered
from tickloom.llm.vectors import Best, finite, power_above, search

SLACK = 1e-12  # of squared distances: a lifted coordinate or a distance near 0 is known to the root of it only
BIGGEST = np.finfo(np.float64).max  # infinite scores are ties, so all of them are looked at
PLAIN = 500  # products of two numbers below 2**500 in size neither overflow nor vanish


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of x with q, summed from the first component to the last, so equal vectors score alike wherever
    they stand. Very large or small vectors are scaled by powers of two first: only a true overflow gives infinity."""
    px, pq = power_above(x), power_above(q)
    px, pq = (0 if abs(p) < PLAIN else p for p in (px, pq))
    x, q = np.ldexp(x, -px) if px else x, np.ldexp(q, -pq) if pq else q
    total = np.add.accumulate(x * q, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))
    with np.errstate(over="ignore"):
        return np.ldexp(np.ldexp(total, px), pq) if px or pq else total


class Tree:
    """Nodes over a permutation of the shard's rows: (vantage, radii of the inner half, of the outer half, halves), leaves (rows,).
    Distances are between rows divided by a power of two above all their components, so none overflows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, leaf: int):
        self.ids, self.rows, self.x = ids, rows, matrix
        self.power = power_above(matrix)
        self.unit = np.ldexp(matrix, -self.power)
        square = np.einsum("ij,ij->i", self.unit, self.unit)
        self.top = float(square.max(initial=0.0))
        self.lifted = np.column_stack([self.unit, np.sqrt(np.maximum(0.0, self.top - square))])
        self.leaf, self.rng = leaf, np.random.default_rng(len(ids))
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, members: np.ndarray) -> tuple:
        if len(members) <= self.leaf:
            return (members,)
        vantage = self.lifted[members[self.rng.integers(len(members))]]
        d = np.linalg.norm(self.lifted[members] - vantage, axis=1)
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        inner, outer = order[:half], order[half:]
        return vantage, (d[inner[0]], d[inner[-1]]), (d[outer[0]], d[outer[-1]]), self._grow(members[inner]), self._grow(members[outer])

    def find(self, own: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        best = Best(len(q), k, np.float64)
        power = np.array([power_above(v) for v in q], dtype=np.int64)  # each query by its own size: it changes no order
        unit = np.ldexp(q, -power[:, None].astype(np.int32))
        norm = np.einsum("ij,ij->i", unit, unit)
        lifted = np.column_stack([unit, np.zeros(len(q))])
        near = np.full(len(q), -np.inf)  # the k-th best score in these units
        error = 1e-12 * np.sqrt(norm * self.top) * max(1, q.shape[1]) + 1e-300

        def walk(node: tuple, active: np.ndarray, bound: np.ndarray) -> None:
            whole = norm[active] + self.top
            live = (bound * factor) ** 2 <= np.maximum(0.0, whole - 2 * near[active]) + SLACK * q.shape[1] * whole  # inf while fewer than k are known
            active, bound = active[live], bound[live]
            if not len(active):
                return
            if len(node) == 1:
                members = node[0]
                rough = unit[active] @ self.unit[members].T
                hit = rough >= (near - error)[active][:, None]
                for i in np.flatnonzero(hit.any(axis=1)):
                    chosen, a = members[hit[i]], active[i]
                    best.add(a, products(self.x[chosen], q[a]), self.ids[chosen], self.rows[chosen], own[a])
                    if best.least[a] is not None:
                        near[a] = np.ldexp(np.ldexp(min(best.least[a], BIGGEST), -self.power), -int(power[a]))
                return
            vantage, inner, outer, first, second = node
            d = np.linalg.norm(lifted[active] - vantage, axis=1)
            gap = lambda r: np.maximum(bound, np.maximum(0.0, np.maximum(r[0] - d, d - r[1])))
            to_inner, to_outer = gap(inner), gap(outer)
            closer = to_inner <= to_outer
            walk(first, active[closer], to_inner[closer])
            walk(second, active[~closer], to_outer[~closer])
            walk(second, active[closer], to_outer[closer])
            walk(first, active[~closer], to_inner[~closer])

        walk(self.root, np.arange(len(q)), np.zeros(len(q)))
        return best.rows()


def nearest_vectors(rows: DataFrame, query_where: str = "vec_id % 20 = 0", k: int = 20, factor: float = 1.0, shard_rows: int = 8192, leaf: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that query_where picks the k other rows of largest inner product; with
    factor over 1, of those found.

    rows: vec_id, embedding; other columns aren't used. Every row is indexed, in the tree of one shard. Scores are inner
    products of the original vectors in double precision, summed in order of the components; ties go to the smaller
    vec_id, null ids first. Vectors of any finite size take part; a product beyond the doubles is infinite. Vectors that
    are null, zero or hold null or non-finite components take no part; vectors of another length than the query's are no
    candidates; fewer than k candidates are all returned. Repeated rows are candidates of one another. An empty table
    gives no rows.
    """
    plain = numbered(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")))
    usable = materialize(plain.filter(finite("vec") & F.exists("vec", lambda x: x != 0)))
    return search(usable, usable.filter(query_where), k, shard_rows, lambda i, r, m: Tree(i, r, m, leaf), lambda t, own, q, n: t.find(own, q, n, factor), "double")
