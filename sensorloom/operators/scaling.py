"""Robust scaling, reference histograms and the statistics of a day against its reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, Fleet, Scaler
from .quality import channel_rows


def transformed(cells: DataFrame, fleet: Fleet) -> DataFrame:
    """Adds t: the channel's transform of x."""
    return cells.withColumn("t", F.when(F.col("channel").isin(*fleet.log1p), F.log1p("x")).otherwise(F.col("x")))


def calibrate(rounds: DataFrame, fleet: Fleet, scaler: Scaler) -> DataFrame:
    """device, channel, n, median, scale, bypass, substituted from each device's first scaler.rounds rounds.

    Exact percentiles of the transformed values, without missing ones and censored Light. Without spread
    (IQR <= epsilon) or values the channel is bypassed. With scaler.relative a small IQR is replaced by the
    spread of the body.
    """
    first = rounds.withColumn("number", F.row_number().over(Window.partitionBy("device").orderBy("ts"))).where(F.col("number") <= scaler.rounds)
    cells = transformed(channel_rows(first, "censored"), fleet).where(F.col("x").isNotNull() & ~((F.col("channel") == CHANNELS - 1) & F.col("censored")))
    cells = cells.groupBy("device", "channel").agg(F.count(F.lit(1)).alias("n"), F.percentile("t", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("p"))
    p = lambda k: F.element_at("p", k)
    iqr, body = p(4) - p(2), p(5) - p(1)
    none = iqr <= scaler.epsilon
    small = F.lit(False) if scaler.relative is None else ~none & (body > scaler.epsilon) & (iqr < scaler.relative * body)
    replaced = body / scaler.body
    bypass = none | (small & (replaced <= scaler.epsilon))
    return cells.select("device", "channel", "n", p(3).alias("median"), F.when(bypass, 1.0).when(small, replaced).otherwise(iqr).alias("scale"), bypass.alias("bypass"), (small & ~bypass).alias("substituted"))


def normalize(rounds: DataFrame, parameters: DataFrame, fleet: Fleet) -> DataFrame:
    """device, ts, channel, z: (t - median) / scale; 0 where missing, t where the channel is bypassed or has no parameters."""
    cells = transformed(channel_rows(rounds), fleet)
    own = cells.join(parameters.select("device", "channel", "median", "scale", "bypass"), ["device", "channel"], "left")
    z = F.when(F.col("x").isNull(), 0.0).when(F.coalesce("bypass", F.lit(True)), F.col("t")).otherwise((F.col("t") - F.col("median")) / F.col("scale"))
    return own.select("device", "ts", "channel", z.alias("z"))


def ranked(values: DataFrame, bins: int) -> DataFrame:
    """device, channel, x, n, after, m, chosen of a reference's distinct values: each holds the ranks after - n .. after - 1 of m.

    chosen marks the order statistics at floor(j (m - 1) / bins), j = 0..bins. Equal values are counted before
    they are put in order, so a quantised channel sorts few rows.
    """
    own = Window.partitionBy("device", "channel")
    counted = values.where(F.col("x").isNotNull()).groupBy("device", "channel", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.withColumn("after", F.sum("n").over(own.orderBy("x"))).withColumn("m", F.sum("n").over(own))
    # A value is chosen if some j maps into its ranks: the smallest j that reaches the first one decides.
    j = F.ceil((F.col("after") - F.col("n")) * bins / F.greatest(F.col("m") - 1, F.lit(1)))
    return rows.withColumn("chosen", (F.col("m") == 1) | ((j <= bins) & (F.floor(j * (F.col("m") - 1) / bins) < F.col("after"))))


def reference_edges(values: DataFrame, bins: int) -> DataFrame:
    """device, channel, edge: the chosen order statistics of values(device, channel, x)."""
    return ranked(values, bins).where("chosen").select("device", "channel", F.col("x").alias("edge"))


def at_rank(p: float, m, first, last, x):
    """The linear percentile of m values, as a sum over rows that hold the ranks first..last."""
    place = p * (m - 1)
    low, high = F.floor(place), F.ceil(place)
    share = place - low
    return F.sum(F.when(low.between(first, last), x * (1 - share))) + F.sum(F.when((high > low) & high.between(first, last), x * share).otherwise(0.0))


def reference_model(values: DataFrame, bins: int) -> DataFrame:
    """device, channel, m, edges, shares, p10, p50, p90: a row for each reference; shares are its cumulative shares at its edges.

    Each cell of a reference ends in an edge, so the shares hold its whole histogram.
    """
    first, last = F.col("after") - F.col("n"), F.col("after") - 1
    marks = F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct("x", (F.col("after") / F.col("m")).alias("share")))))
    each = ranked(values, bins).groupBy("device", "channel").agg(F.max("m").alias("m"), marks.alias("marks"), *[at_rank(q / 100, F.col("m"), first, last, F.col("x")).alias(f"p{q}") for q in (10, 50, 90)])
    return each.select("device", "channel", "m", F.col("marks.x").alias("edges"), F.col("marks.share").alias("shares"), "p10", "p50", "p90")


def placed(rows: DataFrame, bins: int) -> DataFrame:
    """Adds cell, x's place among the array edges: 0 below the first edge, 1 at it, i for (edge i-1, edge i], one more above the last.

    Found by halving steps, a chain of plain expressions over an array of at most bins + 1 edges.
    """
    rows = rows.withColumn("below", F.lit(0))
    for k in reversed(range((bins + 1).bit_length())):
        # Beyond the last edge get() is null and no step is taken.
        rows = rows.withColumn("below", F.col("below") + F.when(F.get("edges", F.col("below") + (2**k - 1)) < F.col("x"), 2**k).otherwise(0))
    at = F.coalesce(F.get("edges", F.col("below")) == F.col("x"), F.lit(False))
    return rows.withColumn("cell", F.when(~at & (F.col("below") == 0), 0).otherwise(F.col("below") + 1)).drop("below")


def cell_of(values: DataFrame, edges: DataFrame, bins: int = 400) -> DataFrame:
    """Adds cell, see placed; values without edges and nulls are left out. Values are not sorted.

    The arrays are the side that is looked up: left to sizes on disk, Spark may take the values for the smaller side.
    """
    lists = edges.groupBy("device", "channel").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    return placed(values.where(F.col("x").isNotNull()).join(lists.hint("shuffle_hash"), ["device", "channel"]), bins).drop("edges")


def histogram(values: DataFrame, edges: DataFrame, bins: int = 400) -> DataFrame:
    """device, channel, cell, n."""
    return cell_of(values, edges, bins).groupBy("device", "channel", "cell").agg(F.count(F.lit(1)).alias("n"))


def ks_p(d, n, m):
    """The asymptotic p value of a two-sample KS distance: 100 terms, 1 for a tiny argument."""
    lam = F.sqrt(n * m / (n + m)) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 1e-3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms)))


def day_stats(days: DataFrame, model: DataFrame, bins: int = 400) -> DataFrame:
    """device, day, channel, n, d, p, shift, width_x, max_cell_mass of each day against the reference.

    days(device, day, channel, x), model as of reference_model. The distance is taken over the reference's
    cells; shift and width are in units of the reference's P90 - P10 (null where that is not positive).

    Values are counted by cell and by value before anything is put in order, both with partial sums on the map side:
    the distance is taken over a day's cells, at most bins + 2 rows, and the percentiles over its distinct values.
    Between cells that the day uses only the reference's share grows, so the distance lies at the first or last
    value of a cell.
    """
    keys = ["device", "day", "channel"]
    rows = days.where(F.col("x").isNotNull())
    lists = model.select("device", "channel", "edges")
    cells = placed(rows.join(lists.hint("shuffle_hash"), ["device", "channel"]), bins).groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("cells"))
    ranks = F.percentile("x", F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ranks.alias("q")).join(cells, keys).join(model.drop("edges"), ["device", "channel"])
    share = lambda cell: F.when(cell < 1, 0.0).otherwise(F.coalesce(F.get("shares", cell - 1), F.lit(1.0)))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("d"))
    step = lambda a, c: F.struct((a["upto"] + c["c"]).alias("upto"), F.greatest(a["d"], F.abs(a["upto"] / F.col("n") - share(c["cell"] - 1)), F.abs((a["upto"] + c["c"]) / F.col("n") - share(c["cell"]))).alias("d"))
    each = each.withColumn("d", F.aggregate("cells", start, step)["d"]).withColumn("mass", F.array_max(F.transform("cells", lambda c: c["c"])) / F.col("n"))
    width = F.col("p90") - F.col("p10")
    return each.select(
        *keys, "n", "d", ks_p(F.col("d"), F.col("n"), F.col("m")).alias("p"),
        F.when(width > 0, (F.col("q")[1] - F.col("p50")) / width).alias("shift"), F.when(width > 0, (F.col("q")[2] - F.col("q")[0]) / width).alias("width_x"), F.col("mass").alias("max_cell_mass"),
    )


def ks_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, m, d: the two-sample KS distance on the merged values. left and right have keys and x."""
    return ks_split(left.select(*keys, "x", F.lit(True).alias("left")).unionByName(right.select(*keys, "x", F.lit(False).alias("left"))), keys)


def ks_split(values: DataFrame, keys: list[str]) -> DataFrame:
    """ks_exact() of one table values(keys, x, left), read once; where it is dealt by some of the keys, nothing is exchanged."""
    each = values.groupBy(*keys, "x").agg(F.count_if("left").alias("a"), F.count_if(~F.col("left")).alias("b"))
    part, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x")
    each = each.withColumn("n", F.sum("a").over(part)).withColumn("m", F.sum("b").over(part))
    gap = F.abs(F.sum("a").over(upto) / F.col("n") - F.sum("b").over(upto) / F.col("m"))
    return each.where("n > 0 AND m > 0").withColumn("gap", gap).groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("gap").alias("d"))


def g_statistic(left: DataFrame, right: DataFrame, keys: list[str], smooth: float = 0.5) -> DataFrame:
    """keys, cells, g, kl: likelihood ratio of two histograms (keys, cell, n), each cell smoothed, and its effect size."""
    both = left.select(*keys, "cell", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(right.select(*keys, "cell", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    each = both.groupBy(*keys, "cell").agg((F.sum("a") + smooth).alias("a"), (F.sum("b") + smooth).alias("b"))
    part = Window.partitionBy(*keys)
    each = each.withColumn("ta", F.sum("a").over(part)).withColumn("tb", F.sum("b").over(part))
    pooled = (F.col("a") + F.col("b")) / (F.col("ta") + F.col("tb"))
    term = F.col("a") * F.log(F.col("a") / (pooled * F.col("ta"))) + F.col("b") * F.log(F.col("b") / (pooled * F.col("tb")))
    kl = F.col("a") / F.col("ta") * F.log((F.col("a") / F.col("ta")) / (F.col("b") / F.col("tb")))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), (2 * F.sum(term)).alias("g"), F.sum(kl).alias("kl"))
