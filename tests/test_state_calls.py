"""How often stream processors call their state: each call is a round trip between Python and the JVM."""

from collections import Counter

import pandas as pd

from sensorloom.streaming import keyed


class Handle:
    """A state of plain values that counts calls; timers are kept in a set."""

    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def state(self, name, *schema):
        handle, kept = self, {}

        class State:
            def __getattribute__(self, call):
                handle.calls[name] += 1
                return {
                    "exists": lambda: bool(kept), "get": lambda: kept.get(0), "update": lambda v: kept.update({0: v}), "clear": kept.clear,
                    "put": lambda v: kept.update({0: v}), "appendList": lambda v: kept.update({0: [*kept.get(0, []), *v]}),
                    "iterator": lambda: list(kept.items()), "keys": lambda: list(kept), "containsKey": lambda k: k in kept,
                    "getValue": lambda k: kept[k], "updateValue": kept.__setitem__, "removeKey": kept.pop,
                }[call]

        return State()

    getValueState = getMapState = getListState = state


class Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return 1000 * self.at


def run(processor, frame, first=None):
    handle = Handle()
    processor.init(handle)
    if first is not None:
        processor.handleInitialState((1,), first, Times(0))
    list(processor.handleInputRows((1,), iter([frame]), Times(0)))
    return handle, pd.concat(processor.handleExpiredTimer((1,), Times(10**9), None))


def test_bins_are_read_once():
    rows = [(t * 100, 0, t * 100) for t in range(1000)] + [(t * 100 + 100, 1, t * 100) for t in range(0, 1000, 4)] + [(t * 100 + 5000, 1, t * 100) for t in range(1000)]
    handle, out = run(keyed.BinProcessor(5000, 200), pd.DataFrame(rows, columns=["ts", "kind", "round_ts"]))
    assert len(out) == 20 and set(out["admitted"]) == {50} and out["outliers"].sum() == 250
    assert sum(handle.calls.values()) < 20  # not some for each row


def test_days_are_a_value_each():
    rows = [(d * 86_400 + t * 3600, c, float(t + c), False) for d in range(30) for t in range(24) for c in range(5)]
    first = pd.DataFrame([(c, 3, [0.0, 10.0, 20.0], [1 / 3, 2 / 3, 1.0], 1.0, 10.0, 19.0) for c in range(5)], columns=["channel", "m", "edges", "shares", "p10", "p50", "p90"])
    handle, out = run(keyed.DayProcessor("UTC", 720, 0.01, (0.9,) * 5, 0.5, 0.5), pd.DataFrame(rows, columns=["ts", "channel", "x", "guarded"]), first)
    assert len(out) == 150 and set(out["n"]) == {24} and out["evaluable"].all()
    assert handle.calls["timer"] == 1 and sum(handle.calls.values()) < 80  # two for each day, not ten for each of its channels
