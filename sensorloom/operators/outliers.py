"""Distance-based outliers in sliding event-time windows.

A point's neighbours are points of the same device within the radius. It is an outlier in a window if fewer
than k other points of the window are neighbours. Neither points nor pairs are copied into the windows that
hold them: a pair is found once, by a join on device and time bucket, and is counted at the one window end
where it begins or ceases to count for a point. A running sum over these ends gives the stretches of windows
in which a point's number of neighbours stays the same; only outliers become rows of windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, Sliding

DIMENSIONS = [f"x{c}" for c in range(CHANNELS)]


def close_pairs(points: DataFrame, s: Sliding) -> DataFrame:
    """device, ts, other, d: each pair of points closer than a window in time and within the radius, once, other being the earlier one.

    Buckets of one window length turn the time band into an equi-join: a point meets its own bucket and the
    one before.
    """
    bucket = F.floor(F.col("ts") / s.window)
    left = points.select("device", "ts", *DIMENSIONS, F.explode(F.array(bucket - 1, bucket)).alias("bucket"))
    right = points.select("device", F.col("ts").alias("other"), *[F.col(d).alias(f"o_{d}") for d in DIMENSIONS], bucket.alias("bucket"))
    square = sum(((F.col(d) - F.col(f"o_{d}")) * (F.col(d) - F.col(f"o_{d}")) for d in DIMENSIONS[1:]), (F.col("x0") - F.col("o_x0")) * (F.col("x0") - F.col("o_x0")))
    near = (F.col("other") < F.col("ts")) & (F.col("ts") - F.col("other") < s.window) & (F.sqrt(square) <= s.radius)
    return left.join(right, ["device", "bucket"]).where(near).select("device", "ts", "other", F.sqrt(square).alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either point's side."""
    sides = F.array(F.struct("ts", "other"), F.struct(F.col("other").alias("ts"), F.col("ts").alias("other")))
    return pairs.select("device", F.explode(sides).alias("p"), "d").select("device", "p.ts", "p.other", "d")


def neighbour_pairs(points: DataFrame, s: Sliding) -> DataFrame:
    """device, ts, other: points closer than a window in time and within the radius. points(device, ts, x0..x4)."""
    return both_ways(close_pairs(points, s)).select("device", "ts", "other")


def first_end(ts: Column, s: Sliding) -> Column:
    """The first window end of a point; windows are [end - window, end)."""
    return (F.floor(ts / s.slide) + 1) * s.slide


def last_end(ts: Column, s: Sliding) -> Column:
    return F.floor((ts + s.window) / s.slide) * s.slide


def window_sizes(points: DataFrame, s: Sliding) -> DataFrame:
    """device, window_end, points of every window that holds a point: points are counted by slide and length of stay before they meet windows."""
    cells = points.groupBy("device", first_end(F.col("ts"), s).alias("first"), last_end(F.col("ts"), s).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("device", F.explode(F.sequence("first", "last", F.lit(s.slide))).alias("window_end"), "n")
    return each.groupBy("device", "window_end").agg(F.sum("n").alias("points"))


def stretches(points: DataFrame, s: Sliding, radii: list[float]) -> DataFrame:
    """device, ts, start, stop, n0, n1, ...: window ends from start to stop in which a point's neighbours within each radius are as many.

    A later neighbour counts from its own first window on, an earlier one up to its own last window: one mark
    a pair and side. Marks are added up by window end before they are put in order.
    """
    ts, other = F.col("ts"), F.col("other")
    pairs = both_ways(close_pairs(points, Sliding(s.window, s.slide, max(radii), s.k)))
    later = other > ts
    at = F.when(later, first_end(other, s)).otherwise(last_end(other, s) + s.slide)
    marks = pairs.where(F.when(later, at <= last_end(ts, s)).otherwise(at > first_end(ts, s))).select("device", "ts", at.alias("start"), later.cast("long").alias("up"), "d")
    own = points.select("device", "ts", first_end(ts, s).alias("start"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("double").alias("d"))
    ends = marks.unionByName(own).groupBy("device", "ts", "start").agg(
        *[F.count_if((F.col("d") <= r) & (F.col("up") == 1)).alias(f"up{i}") for i, r in enumerate(radii)],
        *[F.count_if((F.col("d") <= r) & (F.col("up") == 0)).alias(f"down{i}") for i, r in enumerate(radii)],
    )
    point = Window.partitionBy("device", "ts")
    order = point.orderBy("start")
    n = [(F.sum(f"down{i}").over(point) + F.sum(F.col(f"up{i}") - F.col(f"down{i}")).over(order)).alias(f"n{i}") for i in range(len(radii))]
    stop = F.coalesce(F.lead("start").over(order) - s.slide, last_end(ts, s))
    # A neighbour that stays as long as the point leaves after the point's last window.
    return ends.select("device", "ts", "start", stop.alias("stop"), *n).where("start <= stop")


def outliers(points: DataFrame, s: Sliding) -> DataFrame:
    """device, ts, window_end, neighbours: a row for each window in which the point is an outlier."""
    few = stretches(points, s, [s.radius]).where(F.col("n0") < s.k)
    return few.select("device", "ts", F.explode(F.sequence("start", "stop", F.lit(s.slide))).alias("window_end"), F.col("n0").alias("neighbours"))


def switched_outliers(points: DataFrame, backfill: DataFrame, s: Sliding) -> DataFrame:
    """device, ts, window_end, neighbours, version of outliers when a device's parameters change version on the way.

    points(device, ts, version, x0..x4) are scaled by their version, null before the first one is known;
    backfill(device, version, ts, x0..x4) has rounds before a version's start, scaled by it. A version begins in the
    slide of its first point: from that slide's window on, the device's points are the version's own and the
    backfilled ones that this window still holds, and only the version's own are judged; older points, those
    of the same slide included, count no more. The first version goes on with the points before it. Each
    version needs a slide of its own.

    Versions are populations of their own, so all come from one pass over marks of pairs: those of backfilled points
    begin at the first window, those of older points end at the switch.
    """
    order = Window.partitionBy("device").orderBy("ts")
    rows = points.withColumn("own", F.coalesce("version", F.first("version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    start = F.coalesce(F.min(F.when(F.col("version").isNotNull(), F.col("ts"))), F.min("ts"))
    turns = rows.groupBy("device", "own").agg(start.alias("start"))
    by_start = Window.partitionBy("device").orderBy("start")
    turns = turns.withColumn("opens", first_end(F.col("start"), s))
    turns = turns.withColumn("first", F.row_number().over(by_start) == 1).withColumn("closes", F.lead("opens").over(by_start)).drop("opens")
    again = backfill.select("device", F.col("version").alias("own"), "ts", *DIMENSIONS).join(turns.where("NOT first"), ["device", "own"])
    again = again.where((F.col("ts") >= first_end(F.col("start"), s) - s.window) & (F.col("ts") < F.col("start")))
    each = rows.select("device", "own", "ts", *DIMENSIONS).unionByName(again.select("device", "own", "ts", *DIMENSIONS))
    keyed = each.withColumn("device", F.struct("device", "own")).drop("own")
    few = stretches(keyed, s, [s.radius]).where(F.col("n0") < s.k)
    few = few.select("device.device", "device.own", "ts", "start", "stop", "n0").withColumnsRenamed({"start": "from", "stop": "upto"}).join(turns, ["device", "own"])
    few = few.where(F.col("first") | (F.col("ts") >= F.col("start")))
    upto = F.least(F.col("upto"), F.coalesce(F.col("closes") - s.slide, F.col("upto")))
    few = few.withColumn("upto", upto).where(F.col("from") <= F.col("upto"))
    found = few.select("device", "ts", F.explode(F.sequence("from", "upto", F.lit(s.slide))).alias("window_end"), F.col("n0").alias("neighbours"), "own", "first", "start")
    known = ~F.col("first") | (F.col("window_end") >= first_end(F.col("start"), s))
    return found.select("device", "ts", "window_end", "neighbours", F.when(known, F.col("own")).alias("version"))


def arrival_outliers(found: DataFrame, s: Sliding) -> DataFrame:
    """Only outliers of the slide in which the point arrived."""
    return found.where((F.col("ts") < F.col("window_end")) & (F.col("ts") >= F.col("window_end") - s.slide))


def window_rates(points: DataFrame, found: DataFrame, s: Sliding) -> DataFrame:
    """device, window_end, points, outliers, rate."""
    whole = window_sizes(points, s)
    some = found.groupBy("device", "window_end").agg(F.count(F.lit(1)).alias("outliers"))
    rows = whole.join(some, ["device", "window_end"], "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))
    return rows.withColumn("rate", F.col("outliers") / F.col("points"))


def device_rates(rates: DataFrame, band: tuple[float, float]) -> DataFrame:
    """device, slides, mean_points, mean_rate, in_band: means over windows, not a ratio of sums."""
    each = rates.groupBy("device").agg(F.count(F.lit(1)).alias("slides"), F.avg("points").alias("mean_points"), F.avg("rate").alias("mean_rate"), F.avg(F.when(F.col("outliers") == 0, 1.0).otherwise(0.0)).alias("zero_share"))
    return each.withColumn("in_band", F.col("mean_rate").between(*band))


def probe(points: DataFrame, s: Sliding, radii: list[float], ks: list[int]) -> DataFrame:
    """radius, k, device, slides, mean_points, mean_rate, zero_share of each setting of a grid.

    Pairs are found once, for the largest radius; each setting reads its outliers off the same stretches.
    """
    found = stretches(points, s, radii)
    settings = [(i, r, k) for i, r in enumerate(radii) for k in ks]
    few = F.array(*[F.when(F.col(f"n{i}") < k, F.lit(j)) for j, (i, _, k) in enumerate(settings)])
    rows = found.select("device", "start", "stop", F.explode(F.array_compact(few)).alias("setting"))
    rows = rows.groupBy("device", "start", "stop", "setting").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("device", F.explode(F.sequence("start", "stop", F.lit(s.slide))).alias("window_end"), "setting", "n")
    some = rows.groupBy("device", "window_end", "setting").agg(F.sum("n").alias("outliers"))
    every = window_sizes(points, s).withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
    windows = every.join(some, ["device", "window_end", "setting"], "left").withColumn("rate", F.coalesce("outliers", F.lit(0)) / F.col("points"))
    each = windows.groupBy("device", "setting").agg(F.count(F.lit(1)).alias("slides"), F.avg("points").alias("mean_points"), F.avg("rate").alias("mean_rate"), F.avg(F.when(F.col("rate") == 0, 1.0).otherwise(0.0)).alias("zero_share"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("setting") + 1)
    return each.select(of([float(r) for _, r, _ in settings]).alias("radius"), of([k for _, _, k in settings]).alias("k"), "device", "slides", "mean_points", "mean_rate", "zero_share")


def pick_radius(probed: DataFrame, low: float, high: float) -> DataFrame:
    """device, k, radius, mean_rate: the radius whose rate lies in the band nearest to its middle, ties to the smallest."""
    middle = (low + high) / 2
    good = probed.where(F.col("mean_rate").between(low, high))
    first = F.row_number().over(Window.partitionBy("device", "k").orderBy(F.abs(F.col("mean_rate") - middle), "radius"))
    return good.withColumn("n", first).where("n = 1").select("device", "k", "radius", "mean_rate")


class Clusters:
    """Micro-clusters of one device: a dense ball of more than k points needs no neighbour counts of its own.

    Points stand in order of arrival in buffers that grow by doubling, those of the window from `lo` to `hi`.
    """

    def __init__(self, s: Sliding):
        self.s, self.lo, self.hi, self.next = s, 0, 0, 1
        self.times, self.rows, self.home = np.empty(64, np.int64), np.empty((64, CHANNELS)), np.empty(64, np.int64)
        self.centers: dict[int, np.ndarray] = {}

    @property
    def at(self) -> np.ndarray:
        return self.times[self.lo : self.hi]

    @property
    def x(self) -> np.ndarray:
        return self.rows[self.lo : self.hi]

    @property
    def member(self) -> np.ndarray:
        """Numbers of the points' clusters, -1 without."""
        return self.home[self.lo : self.hi]

    def room(self) -> None:
        if self.hi == len(self.times):
            n = self.hi - self.lo
            size = max(64, 2 * n)
            for name in ("times", "rows", "home"):
                old = getattr(self, name)
                new = np.empty((size, *old.shape[1:]), old.dtype)
                new[:n] = old[self.lo : self.hi]
                setattr(self, name, new)
            self.lo, self.hi = 0, n

    def insert(self, ts: int, x: np.ndarray) -> None:
        s, home = self.s, -1
        if self.centers:
            names = list(self.centers)
            far = np.linalg.norm(np.stack([self.centers[c] for c in names]) - x, axis=1)
            if far.min() <= s.radius / 2:
                home = names[int(far.argmin())]
        self.room()
        self.times[self.hi], self.rows[self.hi], self.home[self.hi] = ts, x, home
        self.hi += 1
        if home < 0:
            free = np.flatnonzero(self.member < 0)
            close = free[np.linalg.norm(self.x[free] - x, axis=1) <= s.radius / 2]
            if len(close) > s.k:
                self.member[close] = self.next
                self.centers[self.next] = x
                self.next += 1

    def outliers(self) -> np.ndarray:
        """Times of points outside clusters with fewer than k neighbours."""
        free = np.flatnonzero(self.member < 0)
        out = [self.at[i] for i in free if (np.linalg.norm(self.x - self.x[i], axis=1) <= self.s.radius).sum() - 1 < self.s.k]
        return np.array(out, np.int64)

    def expire(self, before: int) -> None:
        self.lo += int(np.searchsorted(self.at, before))
        for c in list(self.centers):
            if (self.member == c).sum() <= self.s.k:
                self.member[self.member == c] = -1
                del self.centers[c]


def clustered_outliers(points: DataFrame, s: Sliding, span: int = 16) -> DataFrame:
    """device, ts, window_end of outliers(), and the window's share of points in micro-clusters.

    A task holds a device's `span` windows of time and the window before them, in which its clusters form;
    windows are reported where they end. Outliers do not depend on the clusters' history, the share does.
    """
    length = span * s.window
    chunk = F.floor(F.col("ts") / length)
    # A point counts in windows that end up to a window after it, which may be the next chunk's.
    rows = points.select("device", "ts", *DIMENSIONS, F.explode(F.array_distinct(F.array(chunk, F.floor((F.col("ts") + s.window) / length)))).alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        ts, x, first = pdf["ts"].to_numpy(np.int64), pdf[DIMENSIONS].to_numpy(float), int(pdf["chunk"].iloc[0]) * length
        state, out, k = Clusters(s), [], 0
        end = (ts[0] // s.slide + 1) * s.slide
        while k < len(ts) or len(state.at):
            if not len(state.at) and ts[k] >= end:
                end = (ts[k] // s.slide + 1) * s.slide
            while k < len(ts) and ts[k] < end:
                state.insert(int(ts[k]), x[k])
                k += 1
            if end >= first + length:
                break
            if end >= first:
                share = float((state.member >= 0).mean()) if len(state.member) else 0.0
                out += [(pdf["device"].iloc[0], int(t), int(end), share) for t in state.outliers()]
            end += s.slide
            state.expire(end - s.window)
        return pd.DataFrame(out, columns=["device", "ts", "window_end", "occupancy"])

    return rows.groupBy("device", "chunk").applyInPandas(run, "device long, ts long, window_end long, occupancy double")


def vector_outliers(vectors: DataFrame, radius: float, k: int) -> DataFrame:
    """label, vec_id, neighbours of vectors with fewer than k others of their label within the radius.

    Each label is cut into blocks, and block meets block: no task holds a whole label.
    """
    rows = vectors.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("blk"))
    blocks = F.sequence(F.lit(0), F.lit(15))
    left = rows.select("label", "vec_id", "v", "blk", F.explode(blocks).alias("other"))
    right = rows.select("label", F.col("vec_id").alias("o_id"), F.col("v").alias("o"), F.col("blk").alias("other"), F.explode(blocks).alias("blk"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"label": a["label"], "vec_id": a["vec_id"], "n": np.zeros(len(a), np.int64)})
        x, y = np.stack(a["v"]), np.stack(b["o"])
        out = []
        for lo in range(0, len(x), 256):
            d = np.sqrt(((x[lo : lo + 256, None, :] - y[None]) ** 2).sum(-1)) if x.shape[1] <= 4 else np.sqrt(np.maximum(0, (x[lo : lo + 256] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[lo : lo + 256] @ y.T))
            same = a["vec_id"].to_numpy()[lo : lo + 256, None] == b["o_id"].to_numpy()[None]
            out.append(((d <= radius) & ~same).sum(1))
        return pd.DataFrame({"label": a["label"], "vec_id": a["vec_id"], "n": np.concatenate(out)})

    counts = left.groupBy("label", "blk", "other").cogroup(right.groupBy("label", "blk", "other")).applyInPandas(run, "label int, vec_id long, n long")
    return counts.groupBy("label", "vec_id").agg(F.sum("n").alias("neighbours")).where(F.col("neighbours") < k)


