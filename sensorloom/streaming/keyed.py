"""Operators with state of their own under Structured Streaming, one processor each.

Rows of a device wait in its state until the watermark has passed them; an event-time timer then folds them in
order of time, whatever order and batches they came in, so that a stream gives what the batch operator gives. Rows
behind the watermark are dropped and counted by Spark. Processors hold plain values alone: the worker that checks
state schemas on the driver does not see the files that executors were sent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CHANNELS, Fleet, Guard, Scaler, Sliding

CELLS = [f"x{c}" for c in range(CHANNELS)]
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """Lends the session the state store that these operators need, and gives its own setting back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def number(v) -> float | None:
    return None if v is None or v != v else float(v)


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark has passed them and hands them to fold() in order of ts and the columns after it."""

    #: Columns of a row, ts (seconds) first, and of the result behind the device.
    row: str
    out: str

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the operator."""

    def wanted(self, row: tuple) -> bool:
        """Whether fold() has a use for a row; others don't wait."""
        return True

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        """Result rows of rows in order; watermark in seconds."""
        raise NotImplementedError

    def wake(self) -> int | None:
        """When fold() must be called again even if no row waits, in seconds; asked after fold()."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.row.split(", ")]
        self.kinds = [c.split(" ", 1)[1] for c in self.row.split(", ")]
        self.waiting = handle.getListState("waiting", self.row)
        self.due = handle.getValueState("due", "at long")
        self.opened(handle)

    def arm(self, at: int) -> None:
        """One timer a key, at the earliest row that waits."""
        was = self.due.get()[0] if self.due.exists() else None
        if was is None or at < was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def plain(self, values: tuple) -> tuple:
        as_kind = {"long": int, "int": int, "boolean": bool, "double": float}
        return tuple(None if v is None or v != v else as_kind[k](v) for v, k in zip(values, self.kinds, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [self.plain(r) for frame in rows for r in frame[self.names].itertuples(index=False)]
        new = [r for r in new if self.wanted(r)]
        if new:
            self.waiting.appendList(new)
            self.arm(1000 * min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() // 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((v is not None, v) for v in r))
        ready = [r for r in rows if r[0] <= watermark]
        rest = rows[len(ready) :]
        self.due.clear()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        found = self.fold(key[0], ready, watermark)
        times = [t for t in (rest[0][0] if rest else None, self.wake()) if t is not None]
        if times:
            self.arm(1000 * min(times))
        if found:
            yield self.frame(key[0], found)

    def frame(self, device, found: list[tuple]) -> pd.DataFrame:
        kinds = [c.strip().split(" ", 1) for c in self.out.split(", ")]
        frame = pd.DataFrame(found, columns=[k[0] for k in kinds])
        frame.insert(0, "device", device)
        return frame.astype({k[0]: {"long": "Int64", "int": "Int32", "boolean": "boolean", "double": float}[k[1]] for k in kinds if k[1] in ("long", "int", "boolean", "double")})

    def close(self) -> None:
        pass


class ScalerProcessor(Ordered):
    """Collects the first rounds of a device, freezes their robust scale, drops them, and scales what follows."""

    row = "ts long, " + ", ".join(f"{c} double" for c in CELLS) + ", censored boolean"
    out = "ts long, warmup boolean, " + ", ".join(f"z{c} double" for c in range(CHANNELS))

    def __init__(self, rounds: int, epsilon: float, relative: float | None, body: float, log1p: tuple[int, ...]):
        self.rounds, self.epsilon, self.relative, self.body, self.log1p = rounds, epsilon, relative, body, log1p

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getListState("sample", "t array<double>")
        self.count = handle.getValueState("count", "n long")
        self.frozen = handle.getValueState("frozen", "median array<double>, scale array<double>, bypass array<boolean>")

    def parameters(self, sample: list) -> tuple[list, list, list]:
        median, scale, bypass = [], [], []
        for c in range(CHANNELS):
            v = [s[0][c] for s in sample if s[0][c] is not None]
            p5, p25, p50, p75, p95 = np.percentile(v, [5, 25, 50, 75, 95]).tolist() if v else [0.0] * 5
            own, body = p75 - p25, p95 - p5
            none = not own > self.epsilon
            small = self.relative is not None and not none and body > self.epsilon and own < self.relative * body
            none = none or (small and body / self.body <= self.epsilon)
            median.append(p50)
            scale.append(1.0 if none else body / self.body if small else own)
            bypass.append(bool(none))
        return median, scale, bypass

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        n = self.count.get()[0] if self.count.exists() else 0
        frozen = self.frozen.get() if self.frozen.exists() else None
        kept, out = [], []
        for ts, *x, censored in rows:
            t = [None if v is None else float(np.log1p(v)) if c in self.log1p else v for c, v in enumerate(x)]
            if frozen is None:
                kept.append(([None if c == CHANNELS - 1 and censored else v for c, v in enumerate(t)],))
                n += 1
                out.append((ts, True, *[0.0 if v is None else v for v in x]))
                if n == self.rounds:
                    frozen = self.parameters([*self.sample.get(), *kept])
                    self.frozen.update(frozen)
                    self.sample.clear()
                    kept = []
            else:
                median, scale, bypass = frozen
                out.append((ts, False, *[0.0 if v is None else v if bypass[c] else (v - median[c]) / scale[c] for c, v in enumerate(t)]))
        if kept:
            self.sample.appendList(kept)
        self.count.update((n,))
        return out


class GuardProcessor(Ordered):
    """Runs of equal values and cold starts of a device."""

    row = "ts long, " + ", ".join(f"{c} double" for c in CELLS)
    out = "ts long, channel int, run_len long, run_start long, stuck boolean, floor boolean, crossed boolean, cold boolean"

    def __init__(self, thresholds: tuple[int, ...], floors: dict[int, tuple[float, ...]], gap: int, cold_gap: int):
        self.thresholds, self.floors, self.gap, self.cold_gap = thresholds, floors, gap, cold_gap

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "last long, x array<double>, at array<long>, n array<long>, start array<long>")

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        last, x, at, n, start = self.runs.get() if self.runs.exists() else (None, [None] * CHANNELS, [0] * CHANNELS, [0] * CHANNELS, [0] * CHANNELS)
        x, at, n, start, out = list(x), list(at), list(n), list(start), []
        for ts, *values in rows:
            cold = last is not None and ts - last > self.cold_gap
            if cold:
                x = [None] * CHANNELS
            last = ts
            for c, v in enumerate(values):
                if v is None:
                    continue
                same = x[c] is not None and x[c] == v and ts - at[c] <= self.gap
                n[c], start[c] = (n[c] + 1, start[c]) if same else (1, ts)
                x[c], at[c] = v, ts
                limit = self.thresholds[c]
                long = limit > 0 and n[c] >= limit
                at_floor = v in self.floors.get(c, ())
                out.append((ts, c, n[c] if long else 0, start[c] if long else 0, long and not at_floor, long and at_floor, n[c] == limit, cold))
        self.runs.update((last, x, at, n, start))
        return out


class OutlierProcessor(StatefulProcessor):
    """Sliding outliers of a device: points by slide, each with its later neighbours and its earlier ones by age in slides.

    A neighbour is met once, when the younger of two points comes; a window counts of a point's earlier
    neighbours those whose slide it still holds. Slides leave the state with the last window that holds them.
    """

    def __init__(self, window: int, slide: int, radius: float, k: int):
        if window % slide:
            raise ValueError("windows are whole numbers of slides")
        self.window, self.slide, self.radius, self.k = window, slide, radius, k
        self.ages = window // slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slides = handle.getMapState("slides", "slide long", "ts array<long>, x array<double>, after array<long>, before array<long>")
        self.waiting = handle.getMapState("waiting", "slide long", "ts array<long>, x array<double>")
        self.upto = handle.getValueState("upto", "slide long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        for at, part in rows.groupby(rows["ts"] // self.slide):
            at = int(at)
            ts, x = [], []
            if self.waiting.containsKey((at,)):
                ts, x = map(list, self.waiting.getValue((at,)))
            else:
                self.handle.registerTimer(1000 * (at + 1) * self.slide)
            self.waiting.updateValue((at,), (ts + [int(t) for t in part["ts"]], x + part[CELLS].to_numpy(float).ravel().tolist()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All windows that the watermark has passed: points of a window's last slide meet the others, then those with few neighbours are reported."""
        end = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000 // self.slide
        held = {k[0]: self.load(v) for k, v in self.slides.iterator()}
        out, upto = [], self.upto.get()[0] if self.upto.exists() else 0
        waiting = sorted(k[0] for k in self.waiting.keys())
        news = [at for at in waiting if at < end]
        for at in [*news, end]:
            # Windows without new points end too, until the state holds no slide.
            for quiet in range(upto + 1, at):
                if not held:
                    break
                self.report(held, quiet, out)
            if at < end:
                ts, x = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                self.meet(held, at, np.array(ts, np.int64), np.array(x, float).reshape(len(ts), CHANNELS))
                self.report(held, at, out)
                upto = at
        self.upto.update((max(upto, end - 1),))
        self.slides.clear()
        for at, (ts, x, after, before) in held.items():
            self.slides.updateValue((at,), (ts.tolist(), x.ravel().tolist(), after.tolist(), before.ravel().tolist()))
        if held and len(news) == len(waiting):
            self.handle.registerTimer(1000 * (end + 1) * self.slide)
        if out:
            frame = pd.DataFrame(out, columns=["ts", "window_end", "neighbours"])
            frame.insert(0, "device", key[0])
            yield frame

    def load(self, value) -> list[np.ndarray]:
        ts, x, after, before = value
        n = len(ts)
        return [np.array(ts, np.int64), np.array(x, float).reshape(n, CHANNELS), np.array(after, np.int64), np.array(before, np.int64).reshape(n, self.ages)]

    def meet(self, held: dict, at: int, ts: np.ndarray, x: np.ndarray) -> None:
        after, before = np.zeros(len(ts), np.int64), np.zeros((len(ts), self.ages), np.int64)
        for other, slot in held.items():
            if at - other < self.ages:
                near = np.sqrt(((x[:, None, :] - slot[1][None, :, :]) ** 2).sum(2)) <= self.radius
                slot[2] += near.sum(0)
                before[:, at - other] += near.sum(1)
        own = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) <= self.radius
        after += own.sum(1) - 1  # points of one slide stay as long as each other
        held[at] = [ts, x, after, before]

    def report(self, held: dict, last: int, out: list) -> None:
        """The window whose last slide is `last`; slides that no later window holds go."""
        first = last - self.ages + 1
        for at in sorted(held):
            ts, _, after, before = held[at]
            n = after + before[:, : at - first + 1].sum(1)
            out += [(int(t), (last + 1) * self.slide, int(m)) for t, m in zip(ts, n, strict=True) if m < self.k]
        if first in held:
            del held[first]

    def close(self) -> None:
        pass


class BinProcessor(Ordered):
    """Rounds and outlier scores of a device in one processor: bins of time with admitted rounds, outliers of the arriving slide, and their rate.

    A bin is closed when the lesser watermark of both streams has passed its end and one slide more, by which all
    its scores are there.
    """

    row = "ts long, kind int, round_ts long"
    out = "bin long, admitted long, outliers long, rate double"

    def __init__(self, width: int, slide: int):
        self.width, self.slide = width, slide

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "bin long", "admitted long, outliers long")

    def wanted(self, row: tuple) -> bool:
        ts, kind, round_ts = row
        return kind == 0 or ts - self.slide <= round_ts < ts  # a score of the slide in which the round arrived

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        """The state's bins are read once and only those that stay open are written."""
        held = {k[0]: tuple(v) for k, v in self.bins.iterator()}
        bins = dict(held)
        for _, kind, round_ts in rows:
            at = round_ts // self.width * self.width
            admitted, outliers = bins.get(at, (0, 0))
            bins[at] = (admitted + (kind == 0), outliers + (kind == 1))
        over = [at for at in sorted(bins) if at + self.width + self.slide <= watermark]
        done = [(at, *bins.pop(at)) for at in over]
        for at in held.keys() - bins.keys():
            self.bins.removeKey((at,))
        for at, n in bins.items():
            if held.get(at) != n:
                self.bins.updateValue((at,), n)
        self.next = min(bins) + self.width + self.slide if bins else None
        return [(at, admitted, outliers, outliers / admitted) for at, admitted, outliers in done if admitted]

    def wake(self) -> int | None:
        return self.next


class CommandProcessor(Ordered):
    """Rounds and commands of a device in one processor, with the pending commands as state.

    Commands are judged at the time of their decision, between the rounds before and after it; the watermark that
    makes a command late stands `lag` seconds behind that time, so verdicts do not hang on how batches fall.
    """

    row = "ts long, kind int, seq long, level int, effective_at long"
    out = "seq long, level int, effective_at long, verdict string, executes long"

    def __init__(self, warm: int, lag: int):
        self.warm, self.lag = warm, lag

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "effective_at long, seq long, level int")
        self.seen = handle.getValueState("seen", "n long, last long")

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        pending, out = [tuple(p) for p in self.pending.get()], []
        for ts, kind, seq, level, effective in rows:
            if kind == 0:  # a round
                n, last = n + 1, ts
                met = sorted(p for p in pending if p[0] <= ts)
                pending = [p for p in pending if p[0] > ts]
                forwarded = [p for p in met if p[2] != 0]
                for p in met:
                    verdict = "pre_freeze" if n <= self.warm else "executed" if p[2] == 0 else "forwarded" if p == forwarded[-1] else "replaced"
                    out.append((p[1], p[2], p[0], verdict, ts if verdict in ("executed", "forwarded") else None))
            elif level not in (0, 1, 2):
                out.append((seq, level, effective, "ignored", None))
            elif effective <= ts - self.lag:
                out.append((seq, level, effective, "late_watermark", None))
            elif last is not None and last >= effective:
                out.append((seq, level, effective, "late_processed", None))
            else:
                pending.append((effective, seq, level))
        if pending:
            self.pending.put(pending)
        else:
            self.pending.clear()
        self.seen.update((n, last))
        return out


class DayProcessor(StatefulProcessor):
    """Statistics and state of each local day of a device against its frozen reference.

    The reference is the processor's initial state. A day keeps its values until a timer at the earliest open day's local
    midnight, a day of 23, 24 or 25 hours after the one before, closes what the watermark has passed. A device's model
    and latches are a value each and a day is one, so a batch makes a few calls of the state for each day of a device.
    """

    out = "day date, channel int, n long, d double, p double, shift double, width_x double, max_cell_mass double, evaluable boolean, deviated boolean, transition string"

    def __init__(self, zone: str, period: int, alpha: float, limits: tuple[float, ...], missing: float, guard: float):
        self.zone, self.period, self.alpha, self.limits, self.missing, self.guard = zone, period, alpha, limits, missing, guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "channel array<int>, m array<long>, edges array<array<double>>, shares array<array<double>>, p10 array<double>, p50 array<double>, p90 array<double>")
        self.days = handle.getMapState("days", "day int", "n long, guarded long, channel array<int>, x array<double>")
        self.latch = handle.getValueState("latch", "channel array<int>")
        self.due = handle.getValueState("due", "at long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        model = [list(c) for c in self.model.get()] if self.model.exists() else [[] for _ in range(7)]
        for r in initialState.itertuples(index=False):
            row = int(r.channel), int(r.m), [float(v) for v in r.edges], [float(v) for v in r.shares], float(r.p10), float(r.p50), float(r.p90)
            for column, v in zip(model, row, strict=True):
                column.append(v)
        self.model.update(tuple(model))

    def midnight(self, day: int) -> int:
        """The second at which a local day (in days since 1970) begins."""
        at = datetime.combine(date(1970, 1, 1) + timedelta(days=day), datetime.min.time(), ZoneInfo(self.zone))
        return int(at.astimezone(UTC).timestamp())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        local = pd.to_datetime(rows["ts"], unit="s", utc=True).dt.tz_convert(self.zone).dt.tz_localize(None)
        rows = rows.assign(day=(local.dt.normalize() - pd.Timestamp(0)).dt.days)
        held = {k[0]: v for k, v in self.days.iterator()}
        for day, part in rows.groupby("day"):
            n, guarded, channel, x = held.get(int(day), (0, 0, [], []))
            there = part[part["x"].notna() & part["channel"].notna()]
            self.days.updateValue((int(day),), (n + len(part), guarded + int(part["guarded"].sum()), [*channel, *map(int, there["channel"])], [*x, *map(float, there["x"])]))
        self.arm(1000 * self.midnight(int(rows["day"].min()) + 1))
        return iter(())

    def arm(self, at: int) -> None:
        """One timer a key, at the end of the earliest open day."""
        was = self.due.get()[0] if self.due.exists() else None
        if was is None or at < was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() // 1000
        held = {k[0]: v for k, v in self.days.iterator()}
        columns = self.model.get() if self.model.exists() else [[]] * 7
        model = {c: m for c, *m in zip(*columns, strict=True)}
        deviated = set(self.latch.get()[0]) if self.latch.exists() else set()
        out = []
        # The latch goes from day to day: all days that are over are closed in order.
        over = [day for day in sorted(held) if self.midnight(day + 1) <= watermark]
        for day in over:
            out += self.closed(day, held[day], model, deviated)
            self.days.removeKey((day,))
        self.latch.update((sorted(deviated),))
        self.due.clear()
        if rest := set(held) - set(over):
            self.arm(1000 * self.midnight(min(rest) + 1))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in self.out.split(", ")])
            frame.insert(0, "device", key[0])
            yield frame.astype({"evaluable": "boolean", "deviated": "boolean"})

    def closed(self, day: int, state: tuple, model: dict, deviated: set) -> list[tuple]:
        """Result rows of a day; deviated holds the channels that deviate and is brought up to the day."""
        rows, guarded, channels, values = state
        expected = (self.midnight(day + 1) - self.midnight(day)) // self.period
        evaluable = 1.0 - rows / expected <= self.missing and guarded / expected <= self.guard
        out = []
        channels, values = np.array(channels, int), np.array(values, float)
        for channel in sorted(set(channels.tolist()) & set(model)):
            m, edges, shares, p10, p50, p90 = model[channel]
            edges, x = np.array(edges), values[channels == channel]
            n = len(x)
            # 0 below the first edge, i in (edge i-1, edge i], one more above the last; the first edge itself is in cell 1.
            cells = np.searchsorted(edges, x, side="left") + 1
            cells[x < edges[0]] = 0
            cells = np.bincount(cells, minlength=len(edges) + 2)
            upto = np.array([0.0, *shares, 1.0])
            d = float(np.abs(np.cumsum(cells) / n - upto).max())
            lam = np.sqrt(n * m / (n + m)) * d
            k = np.arange(1, 101)
            p = 1.0 if lam < 1e-3 else float(min(1.0, max(0.0, 2 * (np.where(k % 2, 1.0, -1.0) * np.exp(-2.0 * k * k * lam * lam)).sum())))
            q10, q50, q90 = np.percentile(x, [10, 50, 90])
            width = p90 - p10
            was = channel in deviated
            now = was
            if evaluable:
                now = (p < self.alpha and d > self.limits[channel]) if not was else d > self.limits[channel]
            (deviated.add if now else deviated.discard)(channel)
            shift, ratio = ((q50 - p50) / width, (q90 - q10) / width) if width > 0 else (None, None)
            turn = "DEVIATE" if now and not was else "RECOVER" if was and not now else None
            out.append((date(1970, 1, 1) + timedelta(days=day), channel, n, d, p, shift, ratio, float(cells.max() / n), bool(evaluable), bool(now), turn))
        return out

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, late: int, initial: DataFrame | None = None) -> DataFrame:
    """processor over a stream of rows(device, ts, ...) whose event time is ts; rows may come `late` seconds behind the latest."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{late} seconds")
    more = {"initialState": initial.groupBy("device")} if initial is not None else {}
    return timed.groupBy("device").transformWithStateInPandas(processor, f"device long, {schema}", "append", "EventTime", **more)


def scaled_stream(rounds: DataFrame, fleet: Fleet, scaler: Scaler, late: int) -> DataFrame:
    """device, ts, warmup, z0..z4 of a stream rounds(device, ts, x0..x4, censored): raw values (0 where missing) during warm-up, scaled ones after."""
    processor = ScalerProcessor(scaler.rounds, scaler.epsilon, scaler.relative, scaler.body, tuple(fleet.log1p))
    return keyed(rounds.select("device", "ts", *CELLS, "censored"), processor, ScalerProcessor.out, late)


def guard_stream(rounds: DataFrame, guard: Guard, cold_gap: int, late: int) -> DataFrame:
    """The columns of repeat_runs() and cold of a stream rounds(device, ts, x0..x4)."""
    processor = GuardProcessor(tuple(guard.thresholds), {k: tuple(v) for k, v in guard.floors.items()}, guard.gap, cold_gap)
    return keyed(rounds.select("device", "ts", *CELLS), processor, GuardProcessor.out, late)


def outlier_stream(points: DataFrame, s: Sliding, late: int) -> DataFrame:
    """device, ts, window_end, neighbours of outliers() of a stream points(device, ts, x0..x4)."""
    return keyed(points.select("device", "ts", *CELLS), OutlierProcessor(s.window, s.slide, s.radius, s.k), "ts long, window_end long, neighbours long", late)


def day_stream(values: DataFrame, model: DataFrame, zone: str, period: int, alpha: float, limits: tuple[float, ...], missing: float, guard: float, late: int) -> DataFrame:
    """device, day, channel, the columns of day_stats(), evaluable, deviated, transition of a stream values(device, ts, channel, x, guarded).

    model as of reference_model(); a day's rows are expected every `period` seconds.
    """
    processor = DayProcessor(zone, period, alpha, tuple(limits), missing, guard)
    return keyed(values.select("device", "ts", "channel", "x", "guarded"), processor, DayProcessor.out, late, model)


def bin_stream(rounds: DataFrame, scores: DataFrame, width: int, slide: int, late_rounds: int, late_scores: int) -> DataFrame:
    """device, bin, admitted, outliers, rate of two streams rounds(device, ts) and scores(device, ts, window_end).

    Each stream has its own watermark, and Spark goes by the lesser one. A score's time is its window's end.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = lambda rows, late: rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{late} seconds")
    left = timed(rounds.select("device", F.col("ts").cast("long").alias("ts"), F.lit(0).alias("kind"), F.col("ts").cast("long").alias("round_ts")), late_rounds)
    right = timed(scores.select("device", F.col("window_end").cast("long").alias("ts"), F.lit(1).alias("kind"), F.col("ts").cast("long").alias("round_ts")), late_scores)
    return left.unionByName(right).groupBy("device").transformWithStateInPandas(BinProcessor(width, slide), f"device long, {BinProcessor.out}", "append", "EventTime")


def command_stream(rounds: DataFrame, commands: DataFrame, warm: int, lag: int, late: int) -> DataFrame:
    """device, seq, level, effective_at, verdict, executes of two streams rounds(device, ts) and commands(device, level, effective_at, decided_at, seq).

    The verdicts of schedule(), each once it is certain; a command that waits for its round has none yet.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    timed = lambda rows: rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{late} seconds")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    left = timed(rounds.select("device", F.col("ts").cast("long").alias("ts"), F.lit(0).alias("kind"), none("long", "seq"), none("int", "level"), none("long", "effective_at")))
    right = timed(commands.select("device", F.col("decided_at").cast("long").alias("ts"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("level").cast("int").alias("level"), F.col("effective_at").cast("long").alias("effective_at")))
    return left.unionByName(right).groupBy("device").transformWithStateInPandas(CommandProcessor(warm, lag), f"device long, {CommandProcessor.out}", "append", "EventTime")
