"""Queries of files and streams: what they write first is derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EVENTS
from ..functions.arrays import rounded
from ..operators import profile
from ..sources import files
from ..streaming import rounds as streams
from .basic import LINES, lines
from .bindings import PERIOD, READINGS, ROUNDS, readings
from .shared import scratch

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def folder(spark, sf_dir):
    """The events as raw text files, a folder a device."""
    path = scratch(spark, "raw")
    lines(spark, sf_dir).select("value", (F.col("seq") % 4).alias("part")).write.partitionBy("part").text(path)
    return path


@query(f"WITH {READINGS} SELECT 'data' AS kind, count(DISTINCT seq % 4) AS folders FROM readings")
def src_discover(spark, sf_dir):
    found = files.discover(spark, folder(spark, sf_dir)).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("kind").agg(F.count_distinct("folder").alias("folders"))


@query(f"WITH {READINGS} SELECT true AS data, count(DISTINCT seq % 4) AS folders FROM readings")
def src_sniff(spark, sf_dir):
    found = files.sniff(files.numbered_lines(spark, folder(spark, sf_dir))).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("data").agg(F.count_distinct("folder").alias("folders"))


@query(f"WITH {READINGS} SELECT 'part=' || CAST(seq % 4 AS VARCHAR) AS folder, count(*) AS lines, CAST(0 AS BIGINT) AS headers FROM readings GROUP BY ALL")
def src_inventory(spark, sf_dir):
    found = profile.inventory(spark.read.text(folder(spark, sf_dir))).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("folder").agg(F.sum("lines").alias("lines"), F.sum("headers").alias("headers"))


@query(f"WITH {LINES} SELECT CASE WHEN device = '' THEN 'malformed_no_device' WHEN good THEN 'ok' ELSE 'malformed' END AS status, count(*) AS n FROM parsed GROUP BY ALL")
def src_load_file(spark, sf_dir):
    return files.load(files.numbered_lines(spark, folder(spark, sf_dir)), EVENTS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT device, sec AS ts, sensor, count(*) AS n FROM parsed WHERE good AND device <> '' GROUP BY ALL")
def src_global_merge(spark, sf_dir):
    rows = files.merged(files.load(files.numbered_lines(spark, folder(spark, sf_dir)), EVENTS))
    return rows.groupBy("device", "ts", "sensor").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT sensor, count(*) AS n FROM parsed WHERE good GROUP BY sensor")
def src_pandas_csv(spark, sf_dir):
    rows = files.read_csv(spark, folder(spark, sf_dir)).where("bad IS NULL AND Value IS NOT NULL")
    return rows.groupBy(F.col("Sensor").alias("sensor")).agg(F.count(F.lit(1)).alias("n"))


#: The hash of names of up to three characters, in SQL.
_M, _B = "* 1540483477) & 4294967295", "CAST(device AS VARCHAR)"
HASHED = f"""named AS (SELECT *, {_B} AS s FROM readings),
h0 AS (SELECT *, xor(xor(2538058380, length(s)), ascii(substr(s, 1, 1)) + CASE WHEN length(s) > 1 THEN ascii(substr(s, 2, 1)) * 256 ELSE 0 END + CASE WHEN length(s) > 2 THEN ascii(substr(s, 3, 1)) * 65536 ELSE 0 END) AS a FROM named),
h1 AS (SELECT *, (a {_M} AS b FROM h0), h2 AS (SELECT *, (xor(b, b >> 13) {_M} AS c FROM h1), hashed AS (SELECT *, xor(c, c >> 15) & 2147483647 AS h FROM h2)"""


@query(f"WITH {READINGS}, {HASHED} SELECT CAST(CASE WHEN device < 3 THEN device ELSE h % 5 END AS INTEGER) AS partition, count(*) AS n, count(DISTINCT device) AS devices FROM hashed GROUP BY ALL")
def src_partitioner(spark, sf_dir):
    """Three known devices have partitions of their own among five, the others share them all by hash."""
    rows = files.by_device(readings(spark, sf_dir), 5, known=3).repartition("partition")
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device").alias("devices"))


@query(f"WITH {ROUNDS} SELECT device, ts, x0, dup_keys FROM rounds")
def src_jsonl(spark, sf_dir):
    from .bindings import rounds

    path = scratch(spark, "json")
    files.write_json(rounds(spark, sf_dir).select("device", "ts", "x0", "dup_keys"), path, "round")
    return files.read_json(spark, path, "type string, device long, ts long, x0 double, dup_keys long").where("type = 'round'").drop("type")


@query(f"WITH {ROUNDS} SELECT device, ts, x1, incomplete FROM rounds")
def snk_csv(spark, sf_dir):
    from .bindings import rounds

    path = scratch(spark, "csv")
    files.write_csv(rounds(spark, sf_dir).select("device", "ts", "x1", "incomplete"), path)
    return spark.read.option("header", True).schema("device long, ts long, x1 double, incomplete boolean").csv(path)


def stream(spark, sf_dir, parts: int = 3):
    """The events as a stream of files in order of time, one a trigger, then two heartbeats far ahead, then early events once more, which come too late."""
    path = scratch(spark, "stream")
    r = readings(spark, sf_dir).withColumn("time", F.timestamp_seconds("at"))
    low, high = r.agg(F.min("at"), F.max("at")).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        r.where(F.col("at").between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)
    for ahead in (0, 1):
        beat = r.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("device"), "ts", F.lit(high + 90 * 86400 + ahead).cast("long").alias("at"), "sensor", "value")
        beat.withColumn("time", F.timestamp_seconds("at")).select(*r.columns).write.mode("append").parquet(path)
    r.where(F.col("at") < low + step // 2).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, streamed):
    """What a stream has closed, without its heartbeats."""
    return streams.run_to_end(streamed, scratch(spark, "out"), scratch(spark, "state"), "append").where("device >= 0")


@query(f"WITH {READINGS} SELECT device, CAST((sec // 86400 + 1) * 86400 AS BIGINT) AS window_end, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM readings GROUP BY ALL")
def tumbling_60(spark, sf_dir):
    return run(spark, streams.monitor_stream(stream(spark, sf_dir), 86400)).withColumn("total", rounded(F.col("total"), 4))


@query(f"WITH {ROUNDS} SELECT device, ts, x0, x1, x2, x3, x4, dup_keys FROM rounds")
def watermark_source(spark, sf_dir):
    return run(spark, streams.round_stream(stream(spark, sf_dir), EVENTS))


@query(f"""WITH {READINGS}, e AS (SELECT device, value, unnest(generate_series((sec // {PERIOD} + 1) * {PERIOD}, ((sec + {4 * PERIOD}) // {PERIOD}) * {PERIOD}, {PERIOD})) AS window_end FROM readings)
SELECT device, CAST(window_end AS BIGINT) AS window_end, count(*) AS n, max(value) AS high FROM e GROUP BY ALL""")
def sliding_stream(spark, sf_dir):
    return run(spark, streams.sliding_stream(stream(spark, sf_dir), 4 * PERIOD, PERIOD))


STORE = "spark.sql.streaming.stateStore.providerClass"


@query()
def drift_stream(spark, sf_dir):
    """The drift events of drift_gate, from keyed state over three batches. The state needs a RocksDB store: the session's setting is lent and given back."""
    from .windowed import elements

    path, out, state = (scratch(spark, x) for x in ("elements", "out", "state"))
    rows = elements(spark, sf_dir)
    last = rows.agg(F.max("ts")).first()[0] or 0
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):  # each part arrives after the one before was read
            rows.where(F.col("ts").between(part * (last + 1) // 3, (part + 1) * (last + 1) // 3 - 1)).write.mode("append").parquet(path)
            found = streams.run_to_end(streams.drift_stream(spark.readStream.schema(rows.schema).parquet(path)), out, state, "append")
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return found


@query(f"WITH {READINGS} SELECT device, count(*) AS n FROM readings GROUP BY device")
def src_resume(spark, sf_dir):
    """A stream that stops and goes on from its checkpoint reads each file once."""
    path, out, state = (scratch(spark, x) for x in ("feed", "out", "state"))
    r = readings(spark, sf_dir).select("seq", "device")
    for half in range(2):
        r.where(F.col("seq") % 2 == half).write.mode("append").parquet(path)
        source = spark.readStream.schema(r.schema).parquet(path)
        source.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("device").agg(F.count(F.lit(1)).alias("n"))
