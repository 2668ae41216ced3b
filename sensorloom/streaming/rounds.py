"""The batch operators under Structured Streaming: rounds, monitoring, sliding counts, drift."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Fleet
from ..operators import drift
from ..operators.drift import COLUMNS, SCHEMA, Detector, Gate, lookup
from . import keyed

#: Out-of-orderness of the sources and the time a round stays open, in seconds: a round is final after both.
LATE, OPEN = 55, 30


def round_stream(readings: DataFrame, fleet: Fleet, late: int = LATE + OPEN) -> DataFrame:
    """Rounds of a stream readings(seq, device, time, sensor, value): one row a device and period, once it is final.

    First values are taken by seq as in the batch operator; readings behind the watermark are dropped and
    counted by Spark.
    """
    first = lambda name: F.min_by(F.when(F.col("sensor") == name, F.col("value")), F.when(F.col("sensor") == name, F.col("seq")))
    seen = sum((F.max((F.col("sensor") == n).cast("int")) for n in fleet.sensors[1:]), F.max((F.col("sensor") == fleet.sensors[0]).cast("int")))
    rows = readings.withWatermark("time", f"{late} seconds").groupBy("device", F.window("time", f"{fleet.period} seconds").alias("w"))
    rows = rows.agg(*[first(n).alias(f"x{c}") for c, n in enumerate(fleet.sensors)], (F.count_if(F.col("sensor").isin(*fleet.sensors)) - seen).cast("long").alias("dup_keys"))
    return rows.select("device", F.unix_timestamp("w.start").alias("ts"), *[f"x{c}" for c in range(len(fleet.sensors))], "dup_keys")


def monitor_stream(readings: DataFrame, width: int, late: int = LATE) -> DataFrame:
    """device, window_end, n, total: tumbling windows of a stream."""
    rows = readings.withWatermark("time", f"{late} seconds").groupBy("device", F.window("time", f"{width} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("device", F.unix_timestamp("w.end").alias("window_end"), "n", "total")


def sliding_stream(readings: DataFrame, width: int, slide: int, late: int = 0) -> DataFrame:
    """device, window_end, n, high: sliding windows of a stream."""
    rows = readings.withWatermark("time", f"{late} seconds").groupBy("device", F.window("time", f"{width} seconds", f"{slide} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
    return rows.select("device", F.unix_timestamp("w.end").alias("window_end"), "n", "high")


class DriftProcessor(StatefulProcessor):
    """Detector and gate of a device as keyed state, cleared by a change of generation; elements of a batch are taken in order of ts."""

    def __init__(self, table: dict, longest: int, rho: float, patience: int):
        self.table, self.longest, self.rho, self.patience = table, longest, rho, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "generation long, window array<double>, pending boolean, ts long, threshold double, reference double, seen int, last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        detector, gate, generation = Detector(self.table, self.longest), Gate(self.rho, self.patience), None
        if self.state.exists():
            generation, window, pending, ts, threshold, reference, seen, last = self.state.get()
            detector.restart(list(window))
            if pending:
                gate.pending = {"ts": ts, "threshold": threshold, "reference": reference, "seen": seen, "last": deque(last, maxlen=6)}
        out = []
        for ts, x, g in pd.concat(list(rows)).sort_values("ts", kind="stable")[["ts", "value", "generation"]].itertuples(index=False):
            if g != generation:
                detector, gate, generation = Detector(self.table, self.longest), Gate(self.rho, self.patience), int(g)
            out += gate.update(int(ts), float(x), detector.update(float(x)))
        p = gate.pending
        self.state.update((generation, [float(v) for v in detector.window], p is not None, p["ts"] if p else 0, p["threshold"] if p else 0.0, p["reference"] if p else 0.0, p["seen"] if p else 0, [float(v) for v in p["last"]] if p else []))
        if out:
            frame = pd.DataFrame(out).reindex(columns=COLUMNS)
            frame.insert(0, "device", key[0])
            yield frame.astype({c: "Int64" for c in ("window_len", "hist_len", "new_len", "checked", "candidate_ts", "ts")} | {"during_check": "boolean", "level": object, "test": object})

    def close(self) -> None:
        pass


class PerformanceProcessor(keyed.Ordered):
    """Hourly medians of a device's scores through detector and gate; a change of the model's generation clears all three.

    An hour is closed by a score of a later hour or, by a timer, `fallback` seconds after its begin.
    """

    row = "ts long, value double, generation long"
    out = SCHEMA.removeprefix("device long, ")

    def __init__(self, table: dict, longest: int, rho: float, patience: int, hour: int, fallback: int):
        self.table, self.longest, self.rho, self.patience, self.hour, self.fallback = table, longest, rho, patience, hour, fallback

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.drift = handle.getValueState("drift", "generation long, window array<double>, pending boolean, ts long, threshold double, reference double, seen int, last array<double>")
        self.bucket = handle.getValueState("bucket", "hour long, x array<double>")

    def fold(self, device, rows: list, watermark: int) -> list[tuple]:
        detector, gate, generation = Detector(self.table, self.longest), Gate(self.rho, self.patience), None
        if self.drift.exists():
            generation, window, pending, ts, threshold, reference, seen, last = self.drift.get()
            detector.restart(list(window))
            if pending:
                gate.pending = {"ts": ts, "threshold": threshold, "reference": reference, "seen": seen, "last": deque(last, maxlen=6)}
        hour, x = self.bucket.get() if self.bucket.exists() else (None, [])
        x, out = list(x), []

        def close() -> None:
            v = float(pd.Series(x).median())
            out.extend(gate.update(int(hour), v, detector.update(v)))

        for ts, value, g in rows:
            if hour is not None and ts >= hour + self.fallback:
                close()
                hour, x = None, []
            if g != generation:
                detector, gate, generation = Detector(self.table, self.longest), Gate(self.rho, self.patience), g
                hour, x = None, []
            at = ts // self.hour * self.hour
            if hour is not None and at != hour:
                close()
                hour, x = None, []
            hour = at
            x.append(value)
        if hour is not None and hour + self.fallback <= watermark:
            close()
            hour, x = None, []
        p = gate.pending
        self.drift.update((generation, [float(v) for v in detector.window], p is not None, p["ts"] if p else 0, p["threshold"] if p else 0.0, p["reference"] if p else 0.0, p["seen"] if p else 0, [float(v) for v in p["last"]] if p else []))
        if hour is None:
            self.bucket.clear()
        else:
            self.bucket.update((hour, x))
            self.handle.registerTimer(1000 * (hour + self.fallback))
        return [tuple(e.get(c) for c in COLUMNS) for e in out]


def performance_stream(scores: DataFrame, late: int, confidence: float = 0.99, rho: float = 0.5, longest: int = 2016, patience: int = 36, hour: int = 3600, fallback: int = 7200) -> DataFrame:
    """The events of drift_events() over hourly_medians() of a stream scores(device, ts, value, generation)."""
    for module in (sys.modules[__name__], drift):
        cloudpickle.register_pickle_by_value(module)
    processor = PerformanceProcessor(lookup(confidence, rho, longest), longest, rho, patience, hour, fallback)
    return keyed.keyed(scores.select("device", "ts", "value", "generation"), processor, PerformanceProcessor.out, late)


def drift_stream(elements: DataFrame, confidence: float = 0.99, rho: float = 0.5, longest: int = 2016, patience: int = 36) -> DataFrame:
    """Drift events of a stream elements(device, ts, value, generation); needs the RocksDB state store."""
    # The state's schema is checked by a worker of the driver, which does not see files sent to executors.
    for module in (sys.modules[__name__], drift):
        cloudpickle.register_pickle_by_value(module)
    processor = DriftProcessor(lookup(confidence, rho, longest), longest, rho, patience)
    return elements.groupBy("device").transformWithStateInPandas(processor, SCHEMA, "append", "none")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over what there is and gives back its result as a table.

    Each batch is written to a folder of its own number, so that a batch that is repeated after a failure
    replaces itself; in complete mode the last batch is the result.
    """
    spark = SparkSession.active()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
