"""What several corpus operators share: sizing, materialising, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these; bytes.split() without arguments splits at exactly them.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all run on one machine may it be unset: then it is one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts the lineage, and a lost executor loses none of it.

    row_group: bytes of a row group, for tables with large rows: a reader takes thousands of rows at once, but not
    beyond a row group, and a writer looks at its size after a hundred rows only unless it is told to look at each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    checks = {f"parquet.{of}.row.check.{end}": 1 for of in ("block.size", "page.size") for end in ("min", "max")}
    df.write.options(**({"parquet.block.size": row_group, **checks} if row_group else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast; further columns of the caller can't clash with ours."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "vec_id": "long"}
    return df.select(*[F.col(c).cast(kinds[k]).alias(k) if k in kinds else F.col(c).alias(k) for k, c in columns.items()])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null; the keys are the left side's."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, same, how).drop(*[f"__{k}" for k in keys])


#: Bytes of an Arrow batch of texts, which Python holds several times over, and its rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 500


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_BYTES (or one row) and BATCH_ROWS; tighter settings stay."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def row_hash(*columns: str):
    """A hash of columns of a row in which a null differs from any value, and from a null elsewhere."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def text_volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size the partitioning."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return row[0], row[1]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def cached_words() -> WordHashes:
    """The worker's own cache: functions that Spark pickles must not carry a copy."""
    return WORDS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(values: np.ndarray, size: int, factor: int, starts: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of `size` consecutive values: a polynomial in an odd factor modulo 2**64, mixed.

    starts: of the runs that begin there alone, gathered one by one; keep: the same, out of all runs' polynomials,
    which is faster for many.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n if starts is None else len(starts), np.uint64)
    for k in range(size):
        total *= np.uint64(factor)
        total += values[k : k + n] if starts is None else values[starts + k]
    return mixed(total if keep is None else total[keep])
