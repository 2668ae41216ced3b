"""What each setting of the drift grid finds of each fault, and which is chosen, against plain loops."""

import pytest

from sensorloom.operators import review
from sensorloom.plans import checks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def grid(spark):
    return checks.grid(spark, SF)


def expected(grid):
    both, parts, events = grid
    times, own = {}, {}
    for r in both.select("granularity", "device", "ts").collect():
        times.setdefault((r["granularity"], r["device"]), []).append(r["ts"])
    for r in events.collect():
        own.setdefault((r["setting"], r["device"]), []).append(r)
    out = {}
    for k, setting in enumerate(checks.SETTINGS):
        for s in parts.collect():
            at = sorted(times.get((setting["granularity"], s["device"]), []))
            seen = own.get((k, s["device"]), [])
            inside = [e for e in seen if s["start"] <= e["candidate_ts"] <= s["stop"] + 21_600]
            starts = [e["ts"] for e in seen if e["level"] == "CANDIDATE"]
            dark = any(t <= s["stop"] and at[min(at.index(t) + 30, len(at) - 1)] >= s["start"] for t in starts)
            c = min((e["ts"] for e in inside if e["level"] == "CANDIDATE"), default=None)
            f = min((e["ts"] for e in inside if e["level"] == "CONFIRM"), default=None)
            n = sum(e["level"] == "CANDIDATE" for e in inside)
            delay = lambda t: (None, None) if t is None else (t - s["start"], sum(s["start"] < x <= t for x in at))  # noqa: B023, E731
            out[k, s["segment"]] = (n, f is not None, dark and not n, *delay(c), *delay(f))
    return out


def test_segments_against_plain_loops(grid):
    both, parts, events = grid
    names = ["candidates", "confirmed", "blind_miss", "candidate_delay", "candidate_elements", "confirm_delay", "confirm_elements"]
    got = {(r["setting"], r["segment"]): tuple(r[n] for n in names) for r in review.segment_report(events, both, parts, checks.SETTINGS).collect()}
    want = expected(grid)
    assert got == want and any(w[1] for w in want.values())


def test_summary_and_choice(grid):
    both, parts, events = grid
    report, rows = expected(grid), review.grid_summary(events, review.segment_report(events, both, parts, checks.SETTINGS), checks.SETTINGS).collect()
    assert sorted(r["setting"] for r in rows) == list(range(36)) and sum(r["chosen"] for r in rows) == 1
    rank = []
    for r in rows:
        own = [w for (k, _), w in report.items() if k == r["setting"]]
        late = [w[5] for w in own if w[1]]
        assert r["with_confirm"] == len(late) and r["with_candidate"] == sum(w[0] > 0 for w in own) and r["blind_misses"] == sum(w[2] for w in own)
        assert r["mean_delay"] == (pytest.approx(sum(late) / len(late)) if late else None)
        rank.append((-len(late), r["confirms"] - len(late), sum(late) / len(late) if late else float("inf"), r["setting"], r["chosen"]))
    assert min(rank)[-1]
