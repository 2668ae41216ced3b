"""Raw files: discovery, sniffing, loading, a global order of time, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Fleet
from ..functions.arrays import murmur2
from ..operators.ingest import parse_lines

NAME_TIME = r"(\d{4})-?(\d{2})-?(\d{2})"
SCHEMA = "Time long, DeviceId string, Sensor string, Value double"


def discover(spark: SparkSession, path: str, pattern: str = r"\.(csv|txt)$") -> DataFrame:
    """path, name, bytes, named_time, kind of every file below a folder, hidden ones left out, oldest name first.

    kind is data for names that match the pattern, else unknown. Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    day = F.regexp_extract(name, NAME_TIME, 0)
    rows = files.withColumn("name", name).where(~name.startswith(".") & ~name.startswith("_")).withColumn("named_time", F.nullif(day, F.lit("")))
    return rows.withColumn("kind", F.when(F.col("name").rlike(pattern), "data").otherwise("unknown")).orderBy("named_time", "path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, value: text lines below a folder; seq numbers them within their file, in the order of the file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    rows = lines.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("at"))).cast("long").alias("seq"), "value")


def sniff(lines: DataFrame, first: int = 5) -> DataFrame:
    """path, data: whether one of a file's first non-empty lines has four columns with a good time and value."""
    parts = F.split("value", ",", -1)
    good = (F.size(parts) == 4) & F.trim(F.try_element_at(parts, F.lit(1))).try_cast("bigint").isNotNull() & F.trim(F.try_element_at(parts, F.lit(4))).try_cast("double").isNotNull()
    rows = lines.where(F.trim("value") != "").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where(F.col("n") <= first)
    return rows.groupBy("path").agg(F.max(good).alias("data"))


def load(lines: DataFrame, fleet: Fleet) -> DataFrame:
    """path, seq, status, device, ts, sensor, reading of lines(path, seq, value)."""
    keyed = lines.withColumn("key", F.struct("path", "seq"))
    parsed = parse_lines(keyed.select(F.col("key").alias("seq"), "value"), fleet)
    return parsed.select("seq.path", "seq.seq", "status", "device", "ts", "sensor", "reading")


def merged(loaded: DataFrame) -> DataFrame:
    """Good readings of all files in one order of time, ties by file and line: a range-partitioned sort."""
    return loaded.where("status = 'ok'").orderBy("ts", "path", "seq")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of CSV files; a line that does not fit has them null and itself in bad."""
    return spark.read.schema(SCHEMA + ", bad string").option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("recursiveFileLookup", True).csv(path)


def by_device(readings: DataFrame, partitions: int, known: int = 8) -> DataFrame:
    """Adds partition: a known device, numbered from 0, has the one of its number if there is such a one; others share by the hash of their name."""
    name = F.coalesce(F.col("device").cast("string"), F.lit(""))
    own = F.col("device").between(0, min(known, partitions) - 1)
    shared = murmur2(name).bitwiseAND(F.lit(2**31 - 1)) % partitions
    return readings.withColumn("partition", F.when(own, F.col("device")).otherwise(shared).cast("int"))


def write_json(rows: DataFrame, path: str, kind: str) -> None:
    """A line of JSON for each row, keyed by device, with its type; absent fields are left out."""
    body = F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(c) for c in rows.columns]))
    rows.select(body.alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
