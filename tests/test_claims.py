"""Claims of reviews, held against plain computation."""

import numpy as np

from sensorloom.config import EVENTS, Scaler
from sensorloom.operators import scaling
from sensorloom.sources import files


def test_replaced_scale_without_spread_is_bypassed(spark):
    """A replaced scale that is no more than epsilon itself falls back to the bypass, and counts as no replacement."""
    # Widths of the middle half and of the body.
    shapes = [(10, 40), (13, 26), (13, 60), (30, 40)]
    series = {d: np.interp(np.linspace(0, 1, 40), [0, 0.05, 0.25, 0.75, 0.95, 1], [0, 50 - b / 2, 50 - i / 2, 50 + i / 2, 50 + b / 2, 100]) for d, (i, b) in enumerate(shapes)}
    rows = [(d, t, *([float(x)] * 4), None, False) for d, xs in series.items() for t, x in enumerate(xs)]
    r = spark.createDataFrame(rows, "device long, ts long, x0 double, x1 double, x2 double, x3 double, x4 double, censored boolean")
    s = Scaler(rounds=40, epsilon=12.0, relative=0.56)
    seen = set()
    for g in scaling.calibrate(r, EVENTS, s).where("channel = 0").collect():
        p5, p25, p75, p95 = np.percentile(series[g["device"]], [5, 25, 75, 95])
        none, small = p75 - p25 <= s.epsilon, p95 - p5 > s.epsilon and p75 - p25 < s.relative * (p95 - p5)
        fallback = not none and small and (p95 - p5) / s.body <= s.epsilon
        assert (g["bypass"], g["substituted"]) == (none or fallback, small and not none and not fallback)
        seen.add("none" if none else "fallback" if fallback else "replaced" if small else "plain")
    assert seen == {"none", "fallback", "replaced", "plain"}


def murmur2(data: bytes) -> int:
    h, mask = 0x9747B28C ^ len(data), 0xFFFFFFFF
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0x5BD1E995 & mask
        h = (h * 0x5BD1E995 & mask) ^ ((k ^ k >> 24) * 0x5BD1E995 & mask)
    if rest := data[len(data) // 4 * 4 :]:
        h = (h ^ int.from_bytes(rest, "little")) * 0x5BD1E995 & mask
    h = (h ^ h >> 13) * 0x5BD1E995 & mask
    return h ^ h >> 15


def test_partitions_of_longer_names(spark):
    """Devices of four digits and more, whose names have a whole word for the hash."""
    devices = [0, 2, 3, 7, 42, 999, 1000, 1001, 4499, 12_345, 1_234_567, 123_456_789]
    rows = files.by_device(spark.createDataFrame([(d,) for d in devices], "device long"), 5, known=3).collect()
    assert {r["device"]: r["partition"] for r in rows} == {d: d if d < 3 else (murmur2(str(d).encode()) & 0x7FFFFFFF) % 5 for d in devices}
