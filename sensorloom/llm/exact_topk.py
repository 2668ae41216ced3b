"""Exact top-k by inner product, with pivot-table elimination.

Distances from every vector to a set of pivots are computed once. By the triangle inequality each gives a lower
bound |d(q, p) - d(x, p)| of a candidate's distance to a query. Taken together they give the largest bound that
they allow: they place a vector's projection on the flat that the pivots span, and its height above it, and two
vectors are no nearer than these are apart (simplex projection), which is never less than any single pivot's
bound. As 2 q.x = |q|^2 + |x|^2 - d(q, x)^2, a lower bound of the distance is an upper bound of the score.
Candidates are evaluated in the order of their bounds until no bound reaches the k-th best score: the result is
exact. A query starts with the k-th best score of a bounded sample, and cells of rows whose ball around a pivot
cannot reach it are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import WHOLE as LIMIT
from .vectors import Index, best, looked_up, usable

SHARD_ROWS = 8192
#: What bounds are raised by, as a share of the squares of a query, a row and the farthest pivot: the error of a sum of
#: up to 63 products in single precision, 65 * 6e-8 of terms that are at most four times these squares, is smaller.
SLACK = 2e-5
EVEN = 0.05  # pivots stand at least this share of the first one's distance off the flat of those before


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; in Python's integers where doubles could round."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < LIMIT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    wide = [sum(int(a) * b for a, b in zip(row, whole)) for row in x]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in wide], np.int64)


class PivotTable(Index):
    """Pivots out of a sample, each as far as can be from the flat of those before it."""

    sharpens = True

    def __init__(self, sample: tuple, width: int, cells: int, top: int, pivots: int, chunk: int):
        _, self.uids, self.points = sample
        self.top, self.chunk = top, chunk
        points = self.points if len(self.points) else np.zeros((1, width))
        # A pivot far out of proportion would cost the others' digits.
        norm = np.sqrt((points * points).sum(1))
        points = points[norm <= 100 * np.median(norm)] if (norm <= 100 * np.median(norm)).any() else points
        chosen, rest, basis = [0], points - points[0], []
        first = None
        while len(chosen) <= min(pivots, width):
            height = np.sqrt((rest * rest).sum(1))
            far = int(height.argmax())
            first = height[far] if first is None else first
            if not height[far] > EVEN * first or not height[far] > 0:
                break
            basis.append(rest[far] / height[far])
            rest = rest - np.outer(rest @ basis[-1], basis[-1])
            chosen.append(far)
        self.pivots = points[chosen]
        edges = self.pivots[1:] - self.pivots[0]
        # Rows of `solve` turn inner products with the edges into coordinates along an orthonormal basis.
        q, r = np.linalg.qr(edges.T) if len(edges) else (np.zeros((width, 0)), np.zeros((0, 0)))
        self.solve, self.square = (np.linalg.inv(r.T) if len(edges) else r), (edges * edges).sum(1)
        # Cells: balls around centres that are far from one another; their radius is found from the rows.
        self.cells = max(1, min(cells, len(points)))
        centers, away = [0], np.linalg.norm(points - points[0], axis=1)
        while len(centers) < self.cells:
            centers.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(points - points[centers[-1]], axis=1))
        self.centers = points[centers]

    def cell_of(self, m: np.ndarray) -> np.ndarray:
        return far_from(m, self.centers).argmin(1).astype(np.int32)

    def table_of(self, m: np.ndarray) -> np.ndarray:
        """Distances to the pivots, as coordinates in their flat and height above it."""
        far = far_from(m, self.pivots)
        inner = (far[:, :1] ** 2 - far[:, 1:] ** 2 + self.square) / 2
        flat = inner @ self.solve.T
        height = np.sqrt(np.maximum(0, far[:, 0] ** 2 - (flat * flat).sum(1)))
        return np.column_stack([flat, height])

    def reach_of(self, m: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.sqrt(((m - self.centers[cells]) ** 2).sum(1))

    def learn(self, reach: np.ndarray) -> None:
        self.radius = reach

    def limits(self, uids: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The k-th best score in the sample; none where there are too few others or doubles could round."""
        out = np.full(len(m), -np.inf)
        if len(self.points) > self.top and np.abs(self.points).max() * np.abs(m).max(initial=0) * m.shape[1] < LIMIT:
            scores = m @ self.points.T
            scores[uids[:, None] == self.uids[None]] = -np.inf
            out = np.partition(scores, -self.top, axis=1)[:, -self.top]
        return out

    def wanted(self, m: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
        norm = np.sqrt((m * m).sum(1))
        bound = m @ self.centers.T + norm[:, None] * self.radius[None]
        slack = 1e-6 * (norm[:, None] ** 2 + (self.centers**2).sum(1)[None] + self.radius[None] ** 2) + 1
        return [np.flatnonzero(b >= v).astype(np.int32) for b, v in zip(bound + slack, limits)]

    def opened(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The rows, what asking() is multiplied with, and the largest component."""
        origin = self.pivots[0]
        return m, short(np.column_stack([self.table_of(m), np.ones(len(m)), m @ origin - origin @ origin + SLACK * (m * m).sum(1)])), np.abs(m).max(initial=0)

    def asking(self, m: np.ndarray) -> np.ndarray:
        """q.x = (q - o).(x - o) + q.o + x.o - o.o; the first term is at most that of the tables."""
        most = (self.pivots**2).sum(1).max()
        return short(np.column_stack([self.table_of(m), m @ self.pivots[0] + SLACK * ((m * m).sum(1) + most) + 1, np.ones(len(m))]))

    def search(self, part, q, numbers, itself, limits, top, looked):
        c, table, most = part
        whole = np.abs(q).max(initial=0) * most * max(1, q.shape[1]) < LIMIT
        kind = np.result_type(numbers, table)
        with np.errstate(over="ignore"):
            least = np.maximum(np.nextafter(limits.astype(kind), kind.type(-np.inf)), np.finfo(kind).min)
        for lo in range(0, len(q), 64):
            bound = numbers[lo : lo + 64] @ table.T
            own = np.flatnonzero(itself[lo : lo + 64] >= 0)
            bound[own, itself[lo + own]] = -np.inf
            reached = bound >= least[lo : lo + 64, None]
            some = np.flatnonzero(reached.any(1))
            row, col = np.nonzero(reached[some])
            many, row = np.bincount(row, minlength=len(some)), some[row]
            few = whole & (many <= self.chunk)
            # A first step would take all of these: they are scored together.
            light = np.isin(row, some[few])
            at_row, at_col = row[light], col[light]
            looked[lo + some[few]] += many[few]
            value = np.einsum("ij,ij->i", c[at_col], q[lo + at_row])
            good = value >= limits[lo + at_row]
            at_row, at_col, value = at_row[good], at_col[good], value[good].astype(np.int64)
            for k in np.unique(at_row).tolist():
                at = at_row == k
                yield lo + k, at_col[at], value[at]
            for k in (lo + some[~few]).tolist():
                line, at = bound[k - lo], np.flatnonzero(reached[k - lo])
                order = at[np.argsort(-line[at], kind="stable")]
                kept, scores, step, done = np.empty(0, np.int64), np.empty(0, np.int64), self.chunk, 0
                while done < len(order):
                    at = order[done : done + step]
                    if len(kept) == top and line[at[0]] < scores[-1]:
                        break
                    done, step = done + len(at), 2 * step
                    both = np.concatenate([kept, at])
                    value = np.concatenate([scores, exact_products(c[at], q[k])])
                    if (value > -(2**63)).all():
                        pick = np.lexsort((both, -value))[:top]
                    else:
                        pick = np.array(sorted(range(len(both)), key=lambda j: (-int(value[j]), both[j]))[:top])
                    kept, scores = both[pick], value[pick]
                looked[k] += done
                yield k, kept, scores


def short(table: np.ndarray) -> np.ndarray:
    """In single precision, whose error SLACK covers, unless products could leave its range."""
    return table.astype(np.float32) if np.abs(table).max(initial=0) < 1e15 else table


def far_from(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * m @ points.T))


def found_products(vectors: DataFrame, every: int = 100, top: int = 10, scale: float = 1024.0, pivots: int = 60, chunk: int = 32, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What top_products() ranks, with the number of rows that each query was compared with (see looked_up())."""
    rows = usable(vectors, zero=True)
    rows = rows.select("vec_id", F.transform("v", lambda x: _floor(x, scale)).alias("v"))
    return looked_up(rows, every, top, shard_rows, lambda sample, width, cells: PivotTable(sample, width, cells, top, pivots, chunk), -1)


def top_products(vectors: DataFrame, every: int = 100, top: int = 10, **how) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors(vec_id, embedding) whose vec_id `every` divides.

    Components become floor(scale * x); the score is their inner product, highest first, ties to the smaller
    vec_id. Rows without an id, with a null vector or with a null or non-finite component take no part; an
    empty vector counts as zeros, and a shorter one ends in zeros. Rows that share a vec_id are different
    rows: each is a query of its own and a candidate of the other. Scores beyond 64 bits stay at the limit.
    With fewer than `top` candidates all are returned; with none, or an empty table, nothing is.
    """
    return best(found_products(vectors, every, top, **how), top, -1)


def _floor(x, scale: float):
    """floor(scale * x) as a double: floor() of Spark gives a long, which large values overflow."""
    y = x * F.lit(float(scale))
    return F.when(F.abs(y) < float(2**52), F.floor(y).cast("double")).otherwise(y)
