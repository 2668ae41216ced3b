"""How the driver's tables stand in for sensor data: events as readings, lineitem as daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENTS
from ..operators import ingest

PERIOD = EVENTS.period
#: Users and suppliers that make one device: devices grow with the tables, a device's own series does not.
USERS, SUPPLIERS = 20, 12
START = 1704067200  # 2024-01-01, when the events begin
#: Rows of lineitem that one task takes at a time, five values each.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, device, ts, at, sensor, value: events by group of users, in rounds of PERIOD seconds; at is the exact second."""
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("seq"), F.expr(f"user_id div {USERS}").alias("device"), (F.floor(at / PERIOD) * PERIOD).alias("ts"), at.alias("at"), F.col("event_type").alias("sensor"), "value")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.assemble_rounds(readings(spark, sf_dir), EVENTS)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, day (days since 1970), channel, x: five measures of lineitem by supplier group and ship date.

    Rows are dealt by device before they become five values each: what follows is by device, needs no further
    exchange, and a task's rows stay as many however large the table is.
    """
    li = table(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // ROWS_A_TASK))
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    cells = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    rows = li.select(F.expr(f"l_suppkey div {SUPPLIERS}").alias("device"), day.alias("day"), cells.alias("cells")).repartition(parts, "device")
    return rows.select("device", "day", F.posexplode("cells").alias("channel", "x"))


#: The same in SQL, as the start of a WITH clause.
READINGS = f"""
readings AS (
  SELECT event_id AS seq, user_id // {USERS} AS device, CAST(floor(epoch(ts) / {PERIOD}) * {PERIOD} AS BIGINT) AS ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type AS sensor,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS channel, value
  FROM events
)"""

_FIRST = ",\n         ".join(f"arg_min(value, seq) FILTER (WHERE channel = {c}) AS x{c}" for c in range(5))
ROUNDS = f"""{READINGS}, rounds AS (
  SELECT device, ts, {_FIRST},
         CAST(count(channel) - count(DISTINCT channel) AS BIGINT) AS dup_keys,
         count(*) FILTER (WHERE channel IS NULL) AS unknown_sensor,
         count(DISTINCT channel) < 5 AS incomplete, false AS censored
  FROM readings GROUP BY device, ts
)"""

CELLS = f"""{ROUNDS}, cells AS (
  SELECT device, ts, unnest([0, 1, 2, 3, 4]) AS channel, unnest([x0, x1, x2, x3, x4]) AS x FROM rounds
)"""

VALUES = f"""
vals AS (
  SELECT l_suppkey // {SUPPLIERS} AS device, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day,
         unnest([0, 1, 2, 3, 4]) AS channel, unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount)]) AS x
  FROM lineitem
)"""


#: Every fourth device's days from the tenth on, five of them, replaced by the days a week before.
_COPIED = f"device % 4 = 0 AND (sec - {START}) // 86400"
COPIED = f"""{READINGS}, copied AS (
  SELECT seq, device, sec, sensor, value FROM readings WHERE NOT coalesce({_COPIED} BETWEEN 10 AND 14, false)
  UNION ALL SELECT seq, device, sec + {7 * 86400}, sensor, value FROM readings WHERE {_COPIED} BETWEEN 3 AND 7
)"""


def copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, device, at, sensor, value: readings in which some days are copies of others."""
    r = readings(spark, sf_dir).select("seq", "device", "at", "sensor", "value")
    day, some = F.floor((F.col("at") - START) / 86400), F.col("device") % 4 == 0
    again = r.where(some & day.between(3, 7)).withColumn("at", F.col("at") + 7 * 86400)
    return r.where(~(some & day.between(10, 14))).unionByName(again)
