"""Hard negatives by segment summaries.

A vector is cut into equal segments at several levels, 1, 4, 16 and so on, down to pairs of components; a segment is
stored as its mean and its deviation (the length of what is left when the mean is taken off). The product of two
segments is the product of their means, times their length, give or take the product of their deviations, so that
summaries bound the score of a pair from both sides. An anchor's candidates are refined level by level:
those whose bounds leave the range that is still wanted fall, and only the rest is scored exactly.

Anchors are a stated set of queries, and rows meet them in blocks: parts of at most about PART_ROWS rows by hash and
groups of anchors, on explicit keys. Positives come from parts of the anchor's own label, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import as_matrix, best_of, packed, unpacked, usable

PART_ROWS, GROUP_ROWS, MOST_TASKS = 4096, 512, 4096
#: Candidates with the best middles of their bounds are scored first, which narrows the range for the others.
FIRST = 32


def levels_of(width: int) -> list[int]:
    """Numbers of segments, from one up to pairs of components; width is a power of two."""
    out = [1]
    while out[-1] * 4 < width // 2:
        out.append(out[-1] * 4)
    return [*out, width // 2] if width > 2 else out


def summaries(m: np.ndarray) -> np.ndarray:
    """Means, times the root of the length, and deviations of every level's segments, a row a vector."""
    out = []
    for n in levels_of(m.shape[1]):
        x = m.reshape(len(m), n, -1)
        mean = x.mean(axis=2)
        out += [mean * np.sqrt(x.shape[2]), np.sqrt(((x - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(out, axis=1)


def bounds(rows: np.ndarray, one: np.ndarray, level: int, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Middles and half widths of the ranges of scores at a level; the widths allow for rounding."""
    lo, n = 2 * sum(counts[:level]), counts[level]
    mid, half = rows[:, lo : lo + n] @ one[lo : lo + n], rows[:, lo + n : lo + 2 * n] @ one[lo + n : lo + 2 * n]
    return mid, half + 0.25 + 1e-9 * (half + np.abs(mid))


def wanted(scores: np.ndarray, above: np.ndarray, below: np.ndarray, top: int) -> list[np.ndarray]:
    """For each range, positions of its `top` best scores; rows stand in the order of their ids."""
    out = []
    for low, high in zip(above, below, strict=True):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        out.append(inside[best_of(-scores[inside], top)])
    return out


def search(rows: np.ndarray, table: np.ndarray, anchor: np.ndarray, one: np.ndarray, open_rows: np.ndarray, above: np.ndarray, below: np.ndarray, top: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Positions and scores of the `top` best of the open rows for each range [above, below], and the number of exact scores."""
    counts = levels_of(rows.shape[1])
    last = len(counts) - 1
    at, scored = np.flatnonzero(open_rows), [np.empty(0, int)]
    points = [np.empty(0)]
    floor = above.copy()
    for level in range(len(counts)):
        if not len(at):
            break
        mid, half = bounds(table[at], one, level, counts)
        if level == 0 or level == last:
            # The best guesses of the coarsest and of the finest level are scored at once.
            inside = np.flatnonzero((mid - half <= below.max()) & (mid + half >= floor.min()))
            guess = inside[best_of(-np.minimum(mid[inside], below.max()), FIRST)]
            scored.append(at[guess])
            points.append(rows[at[guess]] @ anchor)
            s = np.concatenate(points)
            for k, best in enumerate(wanted(s, above, below, top)):
                if len(best) == top:
                    floor[k] = max(floor[k], s[best].min())
            keep = np.ones(len(at), bool)
            keep[guess] = False
            at, mid, half = at[keep], mid[keep], half[keep]
        may = np.zeros(len(at), bool)
        for low, high in zip(floor, below, strict=True):
            may |= (mid + half >= low) & (mid - half <= high)
        at = at[may]
    scored.append(at)
    points.append(rows[at] @ anchor)
    order = np.concatenate(scored)
    s = np.concatenate(points)
    by_id = np.argsort(order, kind="stable")
    order, s = order[by_id], s[by_id]
    best = wanted(s, above, below, top)
    return [order[b] for b in best], [s[b] for b in best], len(order)


def prepared(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, uid, label, v and t (packed components and summaries), in the shared folder."""
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).where("label IS NOT NULL")
    good = usable(rows, zero=True, also=("label",)).withColumn("uid", F.monotonically_increasing_id())
    good = materialize(good.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))), "anchored")
    width = good.agg(F.max(F.size("v"))).first()[0] or 1
    width = 1 << max(1, (width - 1).bit_length())

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = as_matrix(pdf["v"], width)
            yield pdf[["vec_id", "uid", "label"]].assign(v=packed(m), t=packed(summaries(m)))

    return materialize(good.mapInPandas(summed, "vec_id long, uid long, label long, v binary, t binary"), "summed")


def dealt(rows: DataFrame, asks: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(rows, asks) of each pair of part and group, which columns of both sides name."""
    tasks = max(1, min(MOST_TASKS, asks.select(*keys).distinct().count()))
    asks = asks.select([F.col(c).alias(f"q_{c}") for c in asks.columns])  # both sides come from one table
    ours = [f"q_{k}" for k in keys]

    def both(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return run(c, q.rename(columns=lambda name: name.removeprefix("q_")))

    rows, asks = rows.repartition(tasks, *keys), asks.repartition(tasks, *ours)
    return rows.groupBy(*keys).cogroup(asks.groupBy(*ours)).applyInPandas(both, schema)


def as_rows(names: list[str], found: list[tuple[tuple, np.ndarray, np.ndarray]], rows: pd.DataFrame) -> pd.DataFrame:
    """One row a position of `found` (values of the names, positions, scores), with the ids at those positions."""
    many = [len(at) for _, at, _ in found]
    at = np.concatenate([np.empty(0, int), *(at for _, at, _ in found)])
    out = {name: np.repeat(np.array([of[k] for of, _, _ in found], float if name.endswith("score") else np.int64), many) for k, name in enumerate(names)}
    scores = np.concatenate([np.empty(0), *(s for _, _, s in found)])
    return pd.DataFrame({**out, "vec_id": rows["vec_id"].to_numpy()[at], "uid": rows["uid"].to_numpy()[at], "score": scores})


def best_rows(found: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: float = 0.8, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`, one by one where an id is repeated. Components become
    floor(scale * component); a score is an inner product, shorter vectors ending in zeros; it is exact as long as it
    stays below 2 ** 53. Positives are the anchor's best other rows of its label; negatives of a positive are the best
    rows of other labels whose score is from `least` times the positive's score up to that score, ties to smaller
    vec_id. Rows with a null id or label, a null vector or a null or non-finite component take no part; an anchor
    without positives, and a positive without such negatives, have no rows. Other columns are ignored; an empty table
    has no rows.
    """
    kept = prepared(vectors, scale)
    is_anchor = F.col("vec_id") % every == 0
    hashed = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "uid"), count).cast("long")
    share = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    held = kept.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("asks")).where("asks > 0")
    held = held.select("label", share("rows", PART_ROWS).alias("parts"), share("asks", GROUP_ROWS).alias("groups"))
    own = kept.join(held, "label")
    rows = own.withColumn("part", hashed(3, F.col("parts"))).withColumn("grp", spread("groups")).select("label", "part", "grp", "vec_id", "uid", "v", "t")
    asks = own.where(is_anchor).withColumn("grp", hashed(7, F.col("groups"))).withColumn("part", spread("parts")).select("label", "part", "grp", "vec_id", "uid", "v", "t")

    def near(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["vec_id", "uid"])
        m, t, uid = unpacked(c["v"]), unpacked(c["t"]), c["uid"].to_numpy()
        out = []
        if len(c) and len(q):
            for v, s, a, u in zip(unpacked(q["v"]), unpacked(q["t"]), q["vec_id"], q["uid"], strict=True):
                (at,), (scores,), _ = search(m, t, v, s, uid != u, np.array([-np.inf]), np.array([np.inf]), positives)
                out.append(((a, u), at, scores))
        return as_rows(["anchor_id", "anchor_uid"], out, c)

    found = dealt(rows, asks, ["label", "part", "grp"], near, "anchor_id long, anchor_uid long, vec_id long, uid long, score double")
    found = best_rows(found, ["anchor_uid"], positives)
    # At most `positives` entries an anchor.
    found = found.groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "uid", "score"))).alias("good"))
    asked = materialize(kept.where(is_anchor).join(found.withColumnRenamed("anchor_uid", "uid"), "uid"), "asked")

    n, a = kept.count(), asked.count()
    parts, groups = F.lit(max(1, -(-n // PART_ROWS))), F.lit(max(1, -(-a // GROUP_ROWS)))
    rows = kept.withColumn("groups", groups.cast("long")).withColumn("part", hashed(3, parts)).withColumn("grp", spread("groups")).drop("groups")
    asks = asked.select("vec_id", "uid", "label", "v", "t", F.col("good.vec_id").alias("ids"), F.col("good.uid").alias("uids"), F.col("good.score").alias("scores"))
    asks = asks.withColumn("parts", parts.cast("long")).withColumn("grp", hashed(7, groups)).withColumn("part", spread("parts")).drop("parts")

    def hard(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["vec_id", "uid"])
        m, t, uid, label = unpacked(c["v"]), unpacked(c["t"]), c["uid"].to_numpy(), c["label"].to_numpy()
        out = []
        if len(c) and len(q):
            for v, s, (_, x) in zip(unpacked(q["v"]), unpacked(q["t"]), q.iterrows(), strict=True):
                high = np.array(x["scores"], float)
                ats, scores, _ = search(m, t, v, s, label != x["label"], least * high, high, negatives)
                out += [((x["vec_id"], x["uid"], *of), at, got) for *of, at, got in zip(x["ids"], x["uids"], high, ats, scores, strict=True)]
        return as_rows(["anchor_id", "anchor_uid", "positive_id", "positive_uid", "positive_score"], out, c)

    found = dealt(rows, asks, ["part", "grp"], hard, "anchor_id long, anchor_uid long, positive_id long, positive_uid long, positive_score double, vec_id long, uid long, score double")
    found = best_rows(found, ["anchor_uid", "positive_uid"], negatives)
    whole = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), whole("positive_score", "positive_score"), whole("score", "negative_score"))
