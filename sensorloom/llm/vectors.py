"""Dealing a stated set of query vectors against all vectors, block by block.

An index splits the space into cells that a bounded sample of rows lays out; every row lies in one cell, and a
cell with many rows is cut into parts by hash. A part is written once, as one row that holds all of its vectors,
and so is a group of queries. Parts and groups meet in a cartesian product of these rows, which reads parts anew
for each portion of groups and neither shuffles nor writes them: disk is in proportion to the rows, not to their
pairs with groups. The sample also gives each query a limit that its k-th best score is certain to reach, so that
cells which cannot do so are left out. A task keeps the best rows that its queries have found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Whole numbers up to here are exact in a double.
WHOLE = 2.0**53
#: Rows of the sample that reaches the driver, and the share of all rows that it has at most.
SAMPLE, SAMPLE_SHARE = 4096, 0.1
MOST_CELLS, MOST_TASKS = 512, 4096
#: Queries of a group.
QUERY_ROWS = 1024
#: Bytes of the vectors of a part or a group, as doubles.
BLOCK_BYTES = 8 << 20
#: Bytes of parts, or of groups, that a task reads at once.
ROW_GROUP = 8 << 20
#: Tasks that pairs of parts and groups make at least, if there are so many; parts that a task goes through at most.
TASKS, TASK_PARTS = 64, 256


def usable(vectors: DataFrame, zero: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array of double) and the columns of `also`: rows with an id and a vector of finite components; zero: all-zero vectors too."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"), *also).where(F.coalesce(good, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.select("vec_id", v.alias("v"), *also)


def as_matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers as a matrix of doubles; shorter rows end in zeros."""
    out = np.zeros((len(column), width))
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


def packed(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(m, float)]


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def narrow(m: np.ndarray) -> np.ndarray:
    """m in the narrowest kind of number that holds all of it exactly."""
    for kind in (np.int16, np.float32):
        with np.errstate(all="ignore"):
            out = m.astype(kind)
        if np.array_equal(out, m):
            return out
    return m


def narrow_rows(m: np.ndarray) -> list[bytes]:
    """A row each: a letter for the kind of number, and the numbers."""
    out = np.ascontiguousarray(narrow(m))
    return [out.dtype.char.encode() + r.tobytes() for r in out]


def wide_rows(column: pd.Series, width: int) -> np.ndarray:
    """What narrow_rows() made, as a matrix of doubles; shorter rows end in zeros."""
    out = np.zeros((len(column), width))
    if len({(len(x), x[:1]) for x in column}) == 1:
        x = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)[:, 1:]
        x = np.ascontiguousarray(x).view(bytes(column.iloc[0][:1]).decode())
        out[:, : x.shape[1]] = x
    else:
        for k, x in enumerate(column):
            x = np.frombuffer(x, bytes(x[:1]).decode(), offset=1)
            out[k, : len(x)] = x
    return out


def narrow_block(m: np.ndarray) -> bytes:
    out = np.ascontiguousarray(narrow(m))
    return out.dtype.char.encode() + out.tobytes()


def wide_block(block: bytes, width: int) -> np.ndarray:
    return np.frombuffer(block, bytes(block[:1]).decode(), offset=1).reshape(-1, width).astype(float)


class Index:
    """What an operator brings: a layout of cells, limits of queries, and the search of a part.

    cells: their number. cell_of(m): each row's cell. reach_of(m, cells): how far rows are from their cells' centres;
    learn(reach): the farthest of each cell. limits(uids, m): what a query's result is certain to reach. wanted(m,
    limits): the cells that may still hold results of each query. opened(m): a part's rows, as search() takes them;
    asking(m): numbers of each query that are computed once, or nothing. search(...): yields (query, positions, scores)
    for queries that find something, and adds to `looked` the rows that each was compared with. sharpens: whether what
    a query has found in other parts is a limit too, and what does not reach its limit is left out.
    """

    cells: int = 1
    sharpens: bool = False

    def opened(self, m: np.ndarray):
        return m

    def asking(self, m: np.ndarray) -> np.ndarray:
        return np.zeros((len(m), 0))

    def first(self, uids: np.ndarray, m: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, uids and scores of what a query has found in the sample, if a search may miss as many."""
        return [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(m)

    def reach_of(self, m: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.zeros(len(m))

    def learn(self, reach: np.ndarray) -> None:
        pass


class Part:
    """A part's rows in the order of their ids."""

    def __init__(self, row, index: Index, width: int):
        self.number, self.cell = row.block, row.cell
        self.ids, self.uids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.uids, np.int64)
        self.rows = index.opened(wide_block(row.v, width))
        self.by_uid = np.argsort(self.uids, kind="stable")

    def places(self, uids: np.ndarray) -> np.ndarray:
        """Where rows with these uids stand; -1: not here."""
        at = self.by_uid[np.minimum(np.searchsorted(self.uids, uids, sorter=self.by_uid), len(self.uids) - 1)]
        return np.where(self.uids[at] == uids, at, -1)


class Group:
    """A group's queries and the best rows that each has found so far."""

    def __init__(self, row, index: Index, width: int, top: int, best_first: int):
        self.index, self.top, self.best_first = index, top, best_first
        self.ids, self.uids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_uids, np.int64)
        self.m, self.limits = wide_block(row.q_v, width), np.frombuffer(row.q_limits, float).copy()
        self.numbers = index.asking(self.m)
        self.wanted = np.unpackbits(np.frombuffer(row.q_wanted, np.uint8).reshape(len(self.ids), -1), axis=1)
        self.looked = np.zeros(len(self.ids), np.int64)
        kind = np.float64 if best_first > 0 else np.int64
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind))] * len(self.ids)

    def search(self, part: Part) -> None:
        here = np.flatnonzero(self.wanted[:, part.cell])
        if not len(here):
            return
        looked = np.zeros(len(here), np.int64)
        for k, at, scores in self.index.search(part.rows, self.m[here], self.numbers[here], part.places(self.uids[here]), self.limits[here], self.top, looked):
            self.add(here[k], part.ids[at], part.uids[at], scores)
        self.looked[here] += looked

    def add(self, k: int, *new: np.ndarray) -> None:
        ids, uids, scores = (np.concatenate(x) for x in zip(self.found[k], new))
        # ~x is -x - 1, which the smallest number has too.
        pick = np.lexsort((uids, ids, scores if self.best_first > 0 else ~scores))
        if self.index.sharpens:
            pick = pick[scores[pick] >= self.limits[k]]
        pick = pick[: self.top]
        self.found[k] = ids[pick], uids[pick], scores[pick]
        if self.index.sharpens and len(pick) == self.top and abs(float(scores[pick[-1]])) < WHOLE:
            self.limits[k] = max(self.limits[k], scores[pick[-1]])

    def rows(self) -> pd.DataFrame:
        """A row each, and one without vec_id for a query that was compared with rows but has found none."""
        many = np.array([len(x) for x, _, _ in self.found], np.int64)
        at = np.repeat(np.arange(len(many)), np.maximum(many, 1))
        first = np.diff(at, prepend=-1) > 0
        none = many[at] == 0
        columns = {}
        for k, name in enumerate(("vec_id", "uid", "score")):
            values = np.zeros(len(at), self.found[0][k].dtype if self.found else np.int64)
            values[~none] = np.concatenate([x[k] for x in self.found])
            columns[name] = (pd.arrays.FloatingArray if values.dtype.kind == "f" else pd.arrays.IntegerArray)(values, none)
        out = pd.DataFrame({"query_id": self.ids[at], "query_uid": self.uids[at], **columns, "looked": np.where(first, self.looked[at], 0)})
        return out[~none | (out["looked"] > 0)]


def sample_of(rows: DataFrame, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, uids and vectors of at most `size` rows: those with the smallest hashes."""
    got = rows.orderBy("hash", "vec_id", "uid").select("vec_id", "uid", "v").limit(size).toPandas()
    return got["vec_id"].to_numpy(np.int64), got["uid"].to_numpy(np.int64), wide_rows(got["v"], width)


def looked_up(vectors: DataFrame, every: int, top: int, shard_rows: int, index_of, best_first: int) -> DataFrame:
    """query_id, query_uid, vec_id, uid, score (double or long), looked, sampled: what search() of every part found, and first().

    looked counts the rows that a query was compared with in the parts of a task, or in the sample; it stands on the
    first row of each, which has no vec_id where nothing was found. sampled: whether a row comes from the sample alone,
    which holds SAMPLE rows and a share of SAMPLE_SHARE at most. index_of(sample, width) builds the Index on the driver.
    """
    hashed_rows = vectors.withColumns({"uid": F.monotonically_increasing_id(), "hash": F.xxhash64("vec_id", "v"), "width": F.size("v")})

    def kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=narrow_rows(as_matrix(pdf["v"], int(pdf["width"].max()))) if len(pdf) else [])

    kept = materialize(hashed_rows.select("vec_id", "uid", "hash", "width", "v").mapInPandas(kept_rows, "vec_id long, uid long, hash long, width int, v binary"), "vectors")
    asks = F.coalesce(F.count_if(F.col("vec_id") % every == 0), F.lit(0))
    n, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(0))).first()
    width = max(1, width)
    shard_rows, query_rows = (min(x, max(1, BLOCK_BYTES // (8 * width))) for x in (shard_rows, QUERY_ROWS))
    size = min(SAMPLE, int(SAMPLE_SHARE * n))
    index: Index = index_of(sample_of(kept, width, size), width, max(1, min(MOST_CELLS, -(-n // shard_rows))))
    kept = kept.select("vec_id", "uid", "v")

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = wide_rows(pdf["v"], width)
            cells = index.cell_of(m)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cell": cells, "reach": index.reach_of(m, cells)})

    # One row a cell, of which there are at most MOST_CELLS.
    held = kept.mapInPandas(reached, "vec_id long, cell int, reach double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), asks.alias("asks"), F.max("reach").alias("reach")).collect()
    held = {r["cell"]: r for r in held}
    of = lambda name: np.array([held[c][name] if c in held else 0 for c in range(index.cells)])
    index.learn(of("reach").astype(float))
    parts = np.maximum(1, -(-of("n") // shard_rows))
    groups = max(1, -(-int(of("asks").sum()) // query_rows))
    portions = min(MOST_TASKS, groups)
    slots = min(MOST_TASKS, int(parts.sum()), max(-(-TASKS // portions), -(-int(parts.sum()) // TASK_PARTS)))
    in_cell = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    before = lambda values: in_cell(np.cumsum(values) - values)
    hashed = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "uid"), F.greatest(F.lit(1), count))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=index.cell_of(wide_rows(pdf["v"], width)))

    def part_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "uid"])
        ids, uids = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "uid"))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cell": pdf["cell"].iloc[:1], "ids": [ids], "uids": [uids], "v": [narrow_block(wide_rows(pdf["v"], width))]})

    routed = kept.mapInPandas(route, "vec_id long, uid long, v binary, cell int")
    routed = routed.withColumn("block", (before(parts) + hashed(3, in_cell(parts))).cast("int"))
    routed = routed.withColumn("slot", F.col("block") % slots).repartitionById(slots, "slot")
    blocks = materialize(routed.groupBy("slot", "block").applyInPandas(part_of, "block int, cell int, ids binary, uids binary, v binary"), "parts", ROW_GROUP)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, uids = wide_rows(pdf["v"], width), pdf["uid"].to_numpy()
            limit = index.limits(uids, m)
            seen = index.first(uids, m, limit)
            wanted = np.zeros((len(m), index.cells), bool)
            for k, cells in enumerate(index.wanted(m, limit)):
                wanted[k, cells] = True
            bits = [r.tobytes() for r in np.packbits(wanted, axis=1)]
            yield pdf.assign(cell=index.cell_of(m), limit=limit, wanted=bits, **{c: [x[k].tolist() for x in seen] for k, c in enumerate(("ids", "uids", "scores"))})

    own = kept.where(F.col("vec_id") % every == 0)
    own = own.mapInPandas(ask, "vec_id long, uid long, v binary, cell int, limit double, wanted binary, ids array<long>, uids array<long>, scores array<double>")
    # Groups hold queries of cells that follow one another.
    own = own.withColumn("grp", F.floor((before(of("asks")) + hashed(7, in_cell(of("asks")))) / query_rows).cast("int")).drop("cell")
    own = materialize(own, "asked")

    def group_of(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, uids = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "uid"))
        bits = np.unpackbits(np.frombuffer(b"".join(pdf["wanted"]), np.uint8).reshape(len(pdf), -1), axis=1)
        row = {"q_ids": [ids], "q_uids": [uids], "q_v": [narrow_block(wide_rows(pdf["v"], width))], "q_limits": [pdf["limit"].to_numpy(float).tobytes()], "q_wanted": [b"".join(pdf["wanted"])]}
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1].to_numpy(), **row, "cells": [np.flatnonzero(bits.any(0)).tolist()]})

    asked = own.drop("ids", "uids", "scores").withColumn("portion", F.col("grp") % portions).repartitionById(portions, "portion")
    asked = materialize(asked.groupBy("portion", "grp").applyInPandas(group_of, "grp int, q_ids binary, q_uids binary, q_v binary, q_limits binary, q_wanted binary, cells array<int>"), "groups", ROW_GROUP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, found = None, {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                # A part meets all groups of the task before the next one comes.
                if part is None or part.number != row.block:
                    part = Part(row, index, width)
                if row.grp not in found:
                    found[row.grp] = Group(row, index, width, top, best_first)
                found[row.grp].search(part)
        for group in found.values():
            yield group.rows()

    kind = "double" if best_first > 0 else "long"
    pairs = blocks.hint("shuffle_replicate_nl").join(asked, F.array_contains("cells", F.col("cell"))).drop("cells")
    found = small_batches(pairs).mapInPandas(run, f"query_id long, query_uid long, vec_id long, uid long, score {kind}, looked long")
    seen = own.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("query_uid"), F.posexplode_outer(F.arrays_zip("ids", "uids", "scores")).alias("k", "s"))
    looked = F.when(F.coalesce("k", F.lit(0)) == 0, size).otherwise(0).cast("long")
    seen = seen.select("query_id", "query_uid", F.col("s.ids").alias("vec_id"), F.col("s.uids").alias("uid"), F.col("s.scores").cast(kind).alias("score"), looked.alias("looked"), F.lit(True).alias("sampled"))
    return found.withColumn("sampled", F.lit(False)).unionByName(seen)


def best(found: DataFrame, top: int, best_first: int) -> DataFrame:
    """query_id, rank, vec_id, score of looked_up()'s rows: the `top` best of each query; best_first is 1 for small scores first, -1 for large ones."""
    order = [F.col("score").asc() if best_first > 0 else F.col("score").desc(), "vec_id", "uid"]
    rank = F.row_number().over(Window.partitionBy("query_id", "query_uid").orderBy(*order))
    # What the sample gave may have been found again. A query's rows are brought together once, for that and for their ranks.
    found = found.where("vec_id IS NOT NULL").repartition("query_id", "query_uid")
    return found.dropDuplicates(["query_id", "query_uid", "uid"]).withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` smallest scores, ties to the first; rows of a part stand in the order of their ids."""
    if len(scores) > 4 * top:
        cut = np.partition(scores, top - 1)[top - 1]
        near = np.flatnonzero(scores <= cut)
        return near[np.argsort(scores[near], kind="stable")[:top]]
    return np.argsort(scores, kind="stable")[:top]
