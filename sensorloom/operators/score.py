"""Scores of reconstruction errors: calibration with a full covariance, z score and Mahalanobis distance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS

RIDGE, SMALL, PIVOT = 1e-4, 1e-12, 1e-15  # fixed values: ridge on the diagonal, least spread, least pivot
ERRORS = [f"e{c}" for c in range(CHANNELS)]


def inverse(matrix: Column, n: int = CHANNELS) -> Column:
    """The inverse of an n x n matrix (array of rows) by Gauss-Jordan elimination, in each column on the row with the largest entry."""
    unit = lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))
    start = F.transform(matrix, lambda row, i: F.concat(row, unit(i)))

    def step(m: Column, k: Column) -> Column:
        entry = lambda i: F.get(F.get(m, i), k)
        ranked = F.transform(F.sequence(k, F.lit(n - 1)), lambda i: F.struct(F.abs(entry(i)).alias("size"), (-i).alias("at")))
        best = -F.array_max(ranked)["at"]
        own = entry(best)
        pivot = F.transform(F.get(m, best), lambda x: x / F.when(F.abs(own) < PIVOT, PIVOT).otherwise(own))
        # The pivot's row and row k change places.
        moved = F.transform(m, lambda row, i: F.when(i == best, F.get(m, k)).otherwise(row))
        return F.transform(moved, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)
    return F.transform(done, lambda row: F.slice(row, n + 1, n))


def times(a: Column, b: Column, n: int = CHANNELS) -> Column:
    """The product of two matrices of n columns and n rows."""
    cell = lambda row, j: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, k: s + F.get(row, k) * F.get(F.get(b, k), j))
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(row, j)))


def calibrate(errors: DataFrame, active: tuple[int, ...] = tuple(range(CHANNELS)), ridge: float = RIDGE) -> DataFrame:
    """device, n, median, iqr, mean, covariance, inverse of errors(device, wmse, e0..e4).

    Median and IQR (with a floor) are of the weighted error; mean, population covariance (with a ridge) and its
    inverse are of the active channels' errors. One aggregate a device, partial on the map side but for the percentiles.
    """
    n = len(active)
    pairs = {(i, j): f"c{i}{j}" for i in range(n) for j in range(i, n)}
    each = errors.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("wmse", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.array(*[F.avg(ERRORS[c]) for c in active]).alias("mean"),
        *[(F.covar_pop(ERRORS[active[i]], ERRORS[active[j]]) + (ridge if i == j else 0.0)).alias(name) for (i, j), name in pairs.items()],
    )
    rows = F.array(*[F.array(*[F.col(pairs[min(i, j), max(i, j)]) for j in range(n)]) for i in range(n)])
    each = each.select("device", "n", F.col("q")[1].alias("median"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(SMALL)).alias("iqr"), "mean", rows.alias("covariance"))
    return each.withColumn("inverse", inverse(F.col("covariance"), n))


def score(errors: DataFrame, calibrated: DataFrame, threshold: float, active: tuple[int, ...] = tuple(range(CHANNELS))) -> DataFrame:
    """errors with z, mahalanobis and above (z >= threshold) under the device's calibration; devices without one have nulls.

    The Mahalanobis distance is that of the active channels' errors from their mean, no less than 0.
    """
    rows = errors.join(calibrated.select("device", "median", "iqr", "mean", "inverse"), "device", "left")
    off = F.zip_with(F.array(*[F.col(ERRORS[c]) for c in active]), F.col("mean"), lambda x, m: x - m)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("off", off)
    form = dot(F.transform("inverse", lambda row: dot(row, F.col("off"))), F.col("off"))
    z = (F.col("wmse") - F.col("median")) / F.col("iqr")
    return rows.withColumns({"z": z, "mahalanobis": F.sqrt(F.greatest(form, F.lit(0.0))), "above": z >= threshold}).drop("off", "median", "iqr", "mean", "inverse")


def masked_errors(windows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """windows(device, window, x, y, mask) with e0..e4, each channel's mean square error, and wmse, their weighted mean.

    x, y and mask are arrays of rounds of CHANNELS values: input, reconstruction, and true where a value counts.
    Masked values count neither in a channel's mean nor in the weights' sum; a channel without values has error 0.
    """
    def channel(c: int) -> tuple[Column, Column]:
        square = F.zip_with(F.transform("x", lambda r: F.get(r, F.lit(c))), F.transform("y", lambda r: F.get(r, F.lit(c))), lambda a, b: (a - b) * (a - b))
        counts = F.transform("mask", lambda r: F.get(r, F.lit(c)).cast("double"))
        sums = F.aggregate(F.zip_with(square, counts, lambda s, m: F.coalesce(s, F.lit(0.0)) * m), F.lit(0.0), lambda s, v: s + v)
        return sums, F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)

    parts = [channel(c) for c in range(CHANNELS)]
    over = sum((n * w for (_, n), w in zip(parts[1:], weights[1:], strict=True)), parts[0][1] * weights[0])
    total = sum((s * w for (s, _), w in zip(parts[1:], weights[1:], strict=True)), parts[0][0] * weights[0])
    columns = {ERRORS[c]: F.when(n > 0, s / n).otherwise(0.0) for c, (s, n) in enumerate(parts)}
    return windows.withColumns({**columns, "wmse": F.when(over > 0, total / over).otherwise(0.0)})


def fitted(windows: DataFrame, keys: tuple[str, ...] = ("device",), ridge: float | Column = RIDGE) -> DataFrame:
    """keys, rounds, center, covariance, precision of the training windows' rounds; windows(keys, part, x), x an array of rounds.

    The model of the context channel: a round's channel is expected to be what the other four say of it under the
    training rounds' covariance. One aggregate, partial on the map side; the inverse is an expression on its row.
    """
    rounds = windows.where("part = 'train'").select(*keys, F.explode("x").alias("r"), (ridge if isinstance(ridge, Column) else F.lit(ridge)).alias("own_ridge"))
    rounds = rounds.select(*keys, "own_ridge", *[F.get("r", F.lit(c)).alias(f"x{c}") for c in range(CHANNELS)])
    pairs = [(i, j) for i in range(CHANNELS) for j in range(i, CHANNELS)]
    each = rounds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rounds"), F.array(*[F.avg(f"x{c}") for c in range(CHANNELS)]).alias("center"), F.max("own_ridge").alias("own_ridge"), *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in pairs]
    )
    entry = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}") + (F.col("own_ridge") if i == j else 0.0)
    each = each.select(*keys, "rounds", "center", F.array(*[F.array(*[entry(i, j) for j in range(CHANNELS)]) for i in range(CHANNELS)]).alias("covariance"))
    return each.withColumn("precision", inverse(F.col("covariance")))


def reconstructed(windows: DataFrame, models: DataFrame, keys: tuple[str, ...] = ("device",)) -> DataFrame:
    """windows with y, their reconstruction: each value less its row of the precision matrix times the round, over the diagonal entry."""
    both = windows.join(models.select(*keys, "center", "precision"), list(keys))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    expected = lambda r: F.transform(r, lambda v, c: v - dot(F.get("precision", c), F.zip_with(r, "center", lambda x, m: x - m)) / F.get(F.get("precision", c), c))
    return both.withColumn("y", F.transform("x", expected)).drop("center", "precision")


def window_errors(windows: DataFrame, weights: tuple[float, ...] = (1.0,) * CHANNELS) -> DataFrame:
    """masked_errors() of windows(x, y) whose values all count, or by their column mask."""
    if "mask" not in windows.columns:
        windows = windows.withColumn("mask", F.transform("x", lambda r: F.transform(r, lambda v: v.isNotNull())))
    return masked_errors(windows, weights)


def zero_baseline(windows: DataFrame) -> DataFrame:
    """device, part, windows, wmse: the error of a model that gives back zeros, which any model should beat."""
    squares = F.aggregate("x", F.lit(0.0), lambda s, r: s + F.aggregate(r, F.lit(0.0), lambda a, v: a + v * v))
    return windows.groupBy("device", "part").agg(F.count(F.lit(1)).alias("windows"), F.avg(squares / (F.size("x") * CHANNELS)).alias("wmse"))
