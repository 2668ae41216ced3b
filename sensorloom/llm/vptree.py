"""Nearest neighbours with a vantage-point tree per shard.

A node's vantage point splits its vectors at the median distance into a near and a far half. A query visits the
half that its distance points to, and leaves the other out if `factor` times the distance to the border exceeds
the query's k-th best distance so far. Factor 1 is the triangle inequality: the search is exact. Larger factors
prune more and may miss neighbours. The top of the tree is grown on a bounded sample and deals the rows to
shards: by the same rule a query is only sent to the shards that it cannot leave out. Every row is in some
shard's tree. A query begins with its k-th best distance in the sample, so that it prunes from the start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import Index, best, best_of, looked_up, usable

LEAF = 32
SHARD_ROWS = 16_384


def spread_point(points: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Of a few of the rows the one whose distances to some others differ most."""
    tries = random.choice(rows, min(8, len(rows)), replace=False)
    sample = points[random.choice(rows, min(64, len(rows)), replace=False)]
    spread = [np.linalg.norm(sample - points[t], axis=1).std() for t in tries]
    return points[tries[int(np.argmax(spread))]]


def grow(points: np.ndarray, rows: np.ndarray, leaf: int, random: np.random.Generator):
    """A leaf: its rows; a node: vantage point, border, near and far half."""
    if len(rows) <= leaf:
        return rows
    vantage = spread_point(points, rows, random)
    far = np.linalg.norm(points[rows] - vantage, axis=1)
    order = np.argsort(far, kind="stable")
    half = len(rows) // 2
    inner, outer = order[:half], order[half:]
    border = (far[inner].max() + far[outer].min()) / 2
    return vantage, border, grow(points, rows[inner], leaf, random), grow(points, rows[outer], leaf, random)


class Tree:
    """A vantage-point tree over the rows of a matrix, which stand in the order that decides ties."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.points, self.square = points, (points * points).sum(1)
        self.root = grow(points, np.arange(len(points)), leaf, np.random.default_rng(seed))

    def search(self, queries: np.ndarray, top: int, factor: float, itself: np.ndarray, limits: np.ndarray):
        """For each query the positions and distances of its best rows, and how many rows it was compared with; itself: the query's own row, -1 if it is not here."""
        found: list = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        limit, looked = limits.copy(), np.zeros(len(queries), np.int64)
        square = (queries * queries).sum(1)

        def visit(node, at: np.ndarray):
            if not len(at):
                return
            if not isinstance(node, tuple):
                looked[at] += len(node)
                rough = square[at, None] + self.square[node][None] - 2 * queries[at] @ self.points[node].T
                slack = 1e-9 * (1 + square[at, None] + self.square[node][None])
                close = (rough <= limit[at, None] ** 2 + slack) & (node[None] != itself[at, None])
                for k, line in zip(at[close.any(1)], close[close.any(1)]):
                    near = node[line]
                    exact = np.sqrt(((self.points[near] - queries[k]) ** 2).sum(1))
                    rows, d = np.concatenate([found[k][0], near]), np.concatenate([found[k][1], exact])
                    order = np.argsort(rows, kind="stable")
                    rows, d = rows[order], d[order]
                    keep = best_of(d, top)
                    found[k] = rows[keep], d[keep]
                    if len(keep) == top:
                        limit[k] = min(limit[k], d[keep[-1]])
                return
            vantage, border, inner, outer = node
            gap = np.linalg.norm(queries[at] - vantage, axis=1) - border
            # Queries go through a node together, so that it is visited once; they came with a limit already.
            inside = gap < 0
            visit(inner, at[inside | reaches(gap, border, factor, limit[at])])
            visit(outer, at[~inside | reaches(gap, border, factor, limit[at])])

        visit(self.root, np.arange(len(queries)))
        return found, looked


def reaches(gap: np.ndarray, border: float, factor: float, limit: np.ndarray) -> np.ndarray:
    """Which queries cannot leave out the other side of a border."""
    return factor * (np.abs(gap) - 1e-9 * (1 + border)) <= limit


class Forest(Index):
    """The top of the tree over a sample; its leaves are the cells, and each part of a cell has a tree of its own."""

    def __init__(self, sample: tuple, width: int, cells: int, top: int, factor: float, leaf: int):
        self.ids, self.uids, self.points = sample
        self.top, self.factor, self.leaf = top, factor, leaf
        self.leaves: list = []
        size = max(1, -(-len(self.points) // cells))
        root = grow(self.points, np.arange(len(self.points)), size, np.random.default_rng(1)) if cells > 1 and len(self.points) > cells else np.empty(0, np.int64)
        self.root = self.numbered(root)
        self.cells = len(self.leaves)

    def numbered(self, node):
        """The tree with numbers for leaves."""
        if isinstance(node, tuple):
            return node[0], node[1], self.numbered(node[2]), self.numbered(node[3])
        self.leaves.append(node)
        return len(self.leaves) - 1

    def cell_of(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros(len(m), np.int32)

        def down(node, at):
            if not isinstance(node, tuple):
                out[at] = node
                return
            inside = np.linalg.norm(m[at] - node[0], axis=1) < node[1]
            down(node[2], at[inside])
            down(node[3], at[~inside])

        down(self.root, np.arange(len(m)))
        return out

    def limits(self, uids: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The k-th best distance in the sample; none where it has too few others."""
        if len(self.points) <= self.top:
            return np.full(len(m), np.inf)
        square = (m * m).sum(1)[:, None] + (self.points**2).sum(1)[None]
        far = square + 1e-9 * (1 + square) - 2 * m @ self.points.T
        far[uids[:, None] == self.uids[None]] = np.inf
        return np.sqrt(np.maximum(0, np.partition(far, self.top - 1, axis=1)[:, self.top - 1]))

    def first(self, uids: np.ndarray, m: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The sample's best: what pruning leaves out is made up from them, so that a query has as many results as there can be."""
        out = []
        for q, limit, uid in zip(m, limits, uids):
            far = np.sqrt(((self.points - q) ** 2).sum(1))
            at = np.flatnonzero((far <= limit) & (self.uids != uid))
            at = at[np.lexsort((self.uids[at], self.ids[at], far[at]))[: self.top]]
            out.append((self.ids[at], self.uids[at], far[at]))
        return out

    def wanted(self, m: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
        out: list[list] = [[] for _ in m]

        def down(node, at):
            if not isinstance(node, tuple):
                for k in at.tolist():
                    out[k].append(node)
                return
            gap = np.linalg.norm(m[at] - node[0], axis=1) - node[1]
            late = reaches(gap, node[1], self.factor, limits[at])
            down(node[2], at[(gap < 0) | late])
            down(node[3], at[(gap >= 0) | late])

        down(self.root, np.arange(len(m)))
        return [np.array(x, np.int32) for x in out]

    def opened(self, m: np.ndarray) -> Tree:
        return Tree(m, self.leaf)

    def search(self, part, q, numbers, itself, limits, top, looked):
        found, compared = part.search(q, top, self.factor, itself, limits)
        looked += compared
        for k, (rows, far) in enumerate(found):
            if len(rows):
                yield k, rows, far


def found_near(vectors: DataFrame, every: int = 100, top: int = 10, factor: float = 1.0, leaf: int = LEAF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What nearest() ranks, with the number of rows that each query was compared with (see looked_up())."""
    return looked_up(usable(vectors, zero=False), every, top, shard_rows, lambda sample, width, cells: Forest(sample, width, cells, top, factor, leaf), 1)


def nearest(vectors: DataFrame, every: int = 100, top: int = 10, factor: float = 1.0, **how) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors(vec_id, embedding) whose vec_id `every` divides.

    score is the Euclidean distance in doubles, smallest first, ties to the smaller vec_id. Rows without an
    id, with a null or zero vector or with a null or non-finite component take no part; an empty vector is a
    zero vector, and a shorter one ends in zeros. Rows that share a vec_id are different rows: each is a
    query of its own and a candidate of the other. With fewer than `top` candidates all are returned; with
    none, or an empty table, nothing is.
    """
    return best(found_near(vectors, every, top, factor, **how), top, 1)
