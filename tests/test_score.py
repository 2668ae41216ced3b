"""Calibration, scores, context model and masked errors against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from sensorloom.functions.arrays import murmur2
from sensorloom.operators import score
from sensorloom.plans import decisions, registry

SF = "/root/testdata/sf0.01"


def test_inverse_against_numpy(spark):
    rng = np.random.default_rng(1)
    made = [rng.normal(size=(5, 5)) for _ in range(20)] + [np.eye(5)[[1, 2, 0, 4, 3]], np.diag([1e-6, 1.0, 1e6, 3.0, 2.0])]  # pivots that must be looked for
    rows = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(made)], "k int, m array<array<double>>")
    got = {r["k"]: np.array(r["i"]) for r in rows.select("k", score.inverse(F.col("m")).alias("i")).collect()}
    assert all(np.allclose(got[k] @ m, np.eye(5), atol=1e-9) for k, m in enumerate(made))


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(2)
    errors = rng.gamma(2.0, size=(200, 5)) @ np.array([[1, 0.5, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0.2, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1.0]])
    rows = spark.createDataFrame([(k % 2, k, *map(float, e), float(e.mean())) for k, e in enumerate(errors)], "device long, k int, e0 double, e1 double, e2 double, e3 double, e4 double, wmse double")
    for active in ((0, 1, 2, 3, 4), (1, 3)):
        got = score.score(rows, score.calibrate(rows, active), 1.0, active).collect()
        for device in (0, 1):
            own = errors[device::2]
            q = np.percentile(own.mean(1), [25, 50, 75])
            part = own[:, list(active)]
            inverse = np.linalg.inv(np.cov(part.T, bias=True) + 1e-4 * np.eye(len(active)))
            for r in (r for r in got if r["device"] == device):
                off = errors[r["k"]][list(active)] - part.mean(0)
                assert np.isclose(r["z"], (errors[r["k"]].mean() - q[1]) / (q[2] - q[0])) and np.isclose(r["mahalanobis"], np.sqrt(max(0, off @ inverse @ off)))
                assert r["above"] == (r["z"] >= 1.0)


def test_masked_errors_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    x, y, mask = rng.normal(size=(6, 4, 5)), rng.normal(size=(6, 4, 5)), rng.random((6, 4, 5)) < 0.6
    mask[0] = False
    mask[1, :, 2] = False
    weights = (1.0, 2.0, 0.5, 0.0, 1.0)
    rows = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist(), mask[k].tolist()) for k in range(6)], "k int, x array<array<double>>, y array<array<double>>, mask array<array<boolean>>")
    for r in score.masked_errors(rows, weights).collect():
        m, sq = mask[r["k"]], (x[r["k"]] - y[r["k"]]) ** 2
        each = [sq[:, c][m[:, c]].mean() if m[:, c].any() else 0.0 for c in range(5)]
        over = sum(weights[c] * m[:, c].sum() for c in range(5))
        assert np.allclose([r[f"e{c}"] for c in range(5)], each)
        assert np.isclose(r["wmse"], sum(weights[c] * sq[:, c][m[:, c]].sum() for c in range(5)) / over if over else 0.0)


def test_context_scores_against_numpy(spark):
    """ctx_score: each value against what the other channels say of it under the training rounds, window by window."""
    held = {}
    for r in decisions.context_windows(spark, SF).collect():
        held.setdefault(r["device"], []).append((r["window"], r["part"], np.array(r["x"], float)))
    want = {}
    for device, ws in held.items():
        train = [x for _, p, x in ws if p == "train"]
        if not train:
            continue
        rounds = np.concatenate(train)
        mean, precision = rounds.mean(0), np.linalg.inv(np.cov(rounds.T, bias=True) + 1e-4 * np.eye(5))
        errors = {w: (((x - mean) @ precision / np.diag(precision)) ** 2).mean(0) for w, _, x in ws}
        held_out = [errors[w].mean() for w, p, _ in ws if p == "calibrate"]
        q = np.percentile(held_out, [25, 50, 75]) if held_out else None  # without calibration there is no score
        want |= {(device, w): (e.mean() - q[1]) / max(q[2] - q[0], 1e-12) if held_out else None for w, e in errors.items()}
    got = {(r["device"], r["window"]): r["score"] for r in registry.queries()["ctx_score"](spark, SF).collect()}
    assert set(got) == set(want) and got
    assert all(got[k] is None if want[k] is None else np.isclose(got[k], want[k], rtol=1e-6) for k in want)


#: Hashes that are published with the topic client.
HASHES = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107}


def test_hash_of_names(spark):
    rows = spark.createDataFrame([(k,) for k in HASHES], "name string")
    assert {r["name"]: r["h"] for r in rows.select("name", murmur2(F.col("name")).alias("h")).collect()} == HASHES
