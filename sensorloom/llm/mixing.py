"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt into blocks of their source by hash. A source is drawn in epochs: each whole epoch takes
every block in a permutation of its own, the last one as many as its target still needs, and of the block at
the border only some documents. The draws of all sources are then split among the output shards: the root of
a tree holds every source's number of draws, each node gives its left half of the shards an exact share of
its total, composed by a multivariate hypergeometric draw, and the right half the rest. The quotas are exact,
and reruns agree: random numbers depend on the seed and the node alone. The ranges that a node hands down are
disjoint, so no draw is given twice. Within a shard documents are ordered by hash.

The tree is walked in two steps, which compose the same distribution: small sources go in bins, every shard
walks its own path with the bins' numbers, and each bin splits what its shards got among its own sources. A
bin holds at most twice BIN_DRAWS draws or one source, so there is no bound on the number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_null_safe, materialize, row_hash

BIN_DRAWS = 100_000


def word_count(text):
    """Maximal runs of anything but the six ASCII blanks; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, row, source, size, copies: rows that agree in all of it are one unit, drawn together."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_hash("text", "source").alias("row"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    return rows.groupBy("doc_id", "row").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def source_targets(sized: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, sid, docs, source_size, target for each source of units.

    Sources in code-point order, null last, get the weights in turn and share all words by them; a target
    stops at `most` times its source's size, and the excess is shared again by weight until none is above.
    That is one level that all uncapped sources reach by weight: with sources ordered by cap / weight, the
    first whose cap holds the level that those from it on would share. The table has one row a source.
    """
    each = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    each = each.withColumn("sid", place).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    ahead = Window.orderBy(F.col("source_size") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    rest = total - most * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))
    each = each.withColumn("level", rest / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ahead), F.lit(0))))
    held = F.min(F.when(F.col("level") * F.col("w") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("w"), "sid", "level"))).over(whole)
    target = F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("w") * held["level"], F.lit(float("inf"))))
    return each.withColumn("target", target).select("source", "sid", "docs", "source_size", "target")


def split_path(shard: int, shards: int, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of each bin's draws in a shard: the walk from the root of the splitting tree."""
    start, counts, lo, hi = np.zeros_like(counts), counts.copy(), 0, shards
    while hi - lo > 1:
        middle = (lo + hi) // 2
        left = composed(np.random.default_rng([seed, lo, hi]), counts, int(counts.sum()) * (middle - lo) // (hi - lo))
        if shard < middle:
            counts, hi = left, middle
        else:
            start, counts, lo = start + left, counts - left, middle
    return start, counts


def composed(random: np.random.Generator, counts: np.ndarray, share: int) -> np.ndarray:
    """How many of `share` draws come from each of the counts: a multivariate hypergeometric draw, one count after the other."""
    left, rest, pool = np.zeros_like(counts), share, int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        if not rest:
            break
        pool -= n
        left[k] = drawn(random, n, pool, rest)
        rest -= int(left[k])
    return left


def split_bin(members: dict[int, int], quotas: list[tuple[int, int]], key: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """shard, source, lo, hi: a bin's quotas (shard, draws) split among its sources (source, draws), down the same kind of tree."""
    sids = np.array(sorted(members), np.int64)
    got = np.array([n for _, n in quotas], np.int64)
    upto = np.concatenate([[0], np.cumsum(got)])
    given = dict.fromkeys(sids.tolist(), 0)
    stack = [(0, len(quotas), sids, np.array([members[s] for s in sids.tolist()], np.int64))]
    while stack:  # left halves first, so that a source's ranges follow one another
        lo, hi, own, counts = stack.pop()
        if hi - lo == 1:
            for s, n in zip(own.tolist(), counts.tolist()):
                yield quotas[lo][0], s, given[s], given[s] + n
                given[s] += n
            continue
        middle = (lo + hi) // 2
        left = composed(np.random.default_rng([*key, lo, hi]), counts, int(upto[middle] - upto[lo]))
        for a, b, n in ((middle, hi, counts - left), (lo, middle, left)):
            at = np.flatnonzero(n)
            if len(at):
                stack.append((a, b, own[at], n[at]))


def drawn(random: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw. Beyond the generator's range the distribution is inverted from its mode, by ratios of neighbouring terms out to 12 standard deviations."""
    if not sample or not good:
        return 0
    if not bad:
        return sample
    total = good + bad
    if total < 1_000_000_000:
        return int(random.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = (sample * (good / total) * (bad / total) * ((total - sample) / (total - 1))) ** 0.5
    reach = int(12 * spread) + 20
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(low + 1, high + 1, dtype=float)
    rise = np.log(good - x + 1) + np.log(sample - x + 1) - np.log(x) - np.log(bad - sample + x)
    weight = np.concatenate([[0.0], np.cumsum(rise)])
    weight = np.cumsum(np.exp(weight - weight[mode - low]))
    return low + int(np.searchsorted(weight, random.random() * weight[-1], side="right"))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), most: int = 3, seed: int = 20240101, block_docs: int = 500, shard_draws: int = 64) -> tuple[DataFrame, DataFrame]:
    """Units with their targets, and draws: doc_id, row, epoch, shard, place for each time that a unit is taken.

    Of docs(doc_id, text, source): a null text has no words, a null source is a source of its own, rows
    without doc_id are units like others, and rows that agree in id, text and source are one unit that is
    taken for all its copies. A source of no words has target 0 and is not taken. A source's taken words miss
    its target by less than one unit's words, by far less as a rule. An empty table gives empty results.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = materialize(units(docs), "units")
    sources = materialize(source_targets(sized, weights, most), "sources")
    blocks_of = F.least(F.greatest(F.ceil(F.col("docs") / block_docs), F.lit(1)), F.lit(65536))
    # A copy of the row's hash keeps units of one id apart; blocks are dealt by hash, so a hot source has many.
    dealt = join_null_safe(sized, sources, ["source"]).select("doc_id", "row", "source", "size", "copies", "sid", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row"), blocks_of).cast("int").alias("blk"))
    dealt = materialize(dealt, "dealt")
    blocks = dealt.groupBy("sid", "blk", "source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    blocks = blocks.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    blocks = blocks.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("epoch", F.explode(F.sequence(F.lit(0), "whole")))
    turn = Window.partitionBy("sid", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "sid", "blk"), "blk")
    draws = blocks.withColumn("idx", F.row_number().over(turn) - 1).withColumn("upto", F.sum("words").over(turn))
    last = F.col("epoch") == F.col("whole")
    draws = draws.withColumn("left", F.when(last, F.col("need") - (F.col("upto") - F.col("words")))).where(~last | ((F.col("left") > 0) & (F.col("words") > 0)))
    draws = materialize(draws.select("sid", "blk", "epoch", "idx", F.when(F.col("left") < F.col("words"), F.col("left")).alias("left")), "draws")
    # Positions of a source's draws, one epoch after the other.
    order = Window.partitionBy("sid").orderBy("epoch", "idx")
    draws = draws.withColumn("pos", F.row_number().over(order) - 1)
    counted = draws.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    # Bins by running total; a source above the bound is a bin of its own. Sources have one row each here.
    small = F.when(F.col("n") <= BIN_DRAWS, F.col("n")).otherwise(0)
    ahead = F.coalesce(F.sum(small).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = counted.withColumn("alone", F.col("n") > BIN_DRAWS)
    binned = materialize(binned.withColumn("bin", F.when(F.col("alone"), -1 - F.col("sid")).otherwise(F.floor(ahead / BIN_DRAWS))), "bins")
    # A row for each BIN_DRAWS draws or so: what reaches the driver is a row for some fifty million documents.
    bins = sorted((r["bin"], r["n"]) for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    names, counts = np.array([b for b, _ in bins], np.int64), np.array([n for _, n in bins], np.int64)
    shards = max(1, int(-(-counts.sum() // shard_draws)))

    def quotas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                start, got = split_path(int(shard), shards, counts, seed)
                at = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.full(len(at), shard), "bin": names[at], "lo": start[at], "hi": start[at] + got[at]})

    def within(members: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(members["sid"].tolist(), members["n"].tolist()))
        got = got.sort_values("shard")
        rows = list(split_bin(own, list(zip(got["shard"].tolist(), (got["hi"] - got["lo"]).tolist())), [seed + 4, int(members["bin"].iloc[0])])) if len(members) else []
        return pd.DataFrame(rows, columns=["shard", "sid", "lo", "hi"])

    quota = spark.range(shards).mapInPandas(quotas, "shard long, bin long, lo long, hi long")
    whole = quota.where("bin < 0").select("shard", (-1 - F.col("bin")).cast("int").alias("sid"), "lo", "hi")
    shared = binned.where("NOT alone").groupBy("bin").cogroup(quota.where("bin >= 0").groupBy("bin")).applyInPandas(within, "shard long, sid int, lo long, hi long")
    quota = whole.unionByName(shared).select("shard", "sid", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    given = draws.join(quota, ["sid", "pos"]).select("sid", "blk", "epoch", "left", "shard")
    taken = dealt.where("size > 0").join(given, ["sid", "blk"])
    inside = Window.partitionBy("sid", "blk", "epoch").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "row"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("copies")
    # Of the block at the border: units in permuted order as long as they fit; a few times again of those that
    # still could; then the one more whose words come closest to what is left.
    part = taken.where("left is not null").withColumn("in", F.lit(False))
    whole = Window.partitionBy("sid", "blk", "epoch")
    gap = F.col("left") - F.coalesce(F.sum(F.when(F.col("in"), words)).over(whole), F.lit(0))
    for _ in range(4):
        part = part.withColumn("gap", gap).withColumn("fits", ~F.col("in") & (words <= F.col("gap")))
        part = part.withColumn("in", F.col("in") | (F.col("fits") & (F.sum(F.when(F.col("fits"), words)).over(inside) <= F.col("gap"))))
    part = part.withColumn("gap", gap).withColumn("off", F.when(~F.col("in"), F.abs(words - F.col("gap"))))
    nearest = F.row_number().over(whole.orderBy(F.col("off").asc_nulls_last(), "doc_id", "row")) == 1
    part = part.withColumn("one", nearest & (F.col("off") < F.col("gap"))).where("in OR one").drop("in", "one", "gap", "off", "fits")
    taken = taken.where("left is null").unionByName(part)
    return dealt, taken.select("doc_id", "row", "epoch", "shard", F.xxhash64(F.lit(seed + 3), "shard", "epoch", "doc_id", "row").alias("place"))


def mixture_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    dealt, draws = mix(docs, **how)
    times = draws.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    rows = join_null_safe(dealt, times, ["doc_id", "row"], "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.drop("copy")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them, repeats included, in shards that are shuffled within."""
    _, draws = mix(docs, **how)
    draws = draws.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("shard").alias("__shard"), F.col("place").alias("__place"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").cast("long").alias("__key"), row_hash("text", "source").alias("__hash"))
    both = whole.join(draws, whole["__key"].eqNullSafe(draws["__id"]) & (whole["__hash"] == draws["__row"]))
    return both.select("__doc", "__shard", "__place").repartition("__shard").sortWithinPartitions("__shard", "__place").select("__doc.*")
