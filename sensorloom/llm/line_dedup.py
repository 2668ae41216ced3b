"""Line dedup on hashes, with per-document bitmaps (DataFrame functions only).

Lines travel as 128-bit hashes of their keys with document and position. They are range-partitioned by hash
and salted by document, so that one line that a third of all rows hold is spread over many ranges, and sorted
within by document and position; a window streams over each range and marks a key's first occurrence in each
document. Counting those and taking the largest document adds up to one row a key and range before it is
shuffled again. Frequent keys then meet their lines: a key with more than one in HOT of all lines by broadcast
(there are fewer than HOT such keys, whatever the input), the others in a shuffled join, in which no key has
more than that share. The lines to go come back to the documents as bitmaps: 64 lines a word, words without a
dropped line left out. The texts themselves move once, to meet their bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)  # a row without doc_id comes before all others
HOT = 1000
SALT_ROWS = 4_000_000  # lines that one salt stands for


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, row, gone: for each document that loses lines, a map from word number to the 64 lines' bits.

    doc is doc_id, or the smallest long for null; row is a hash of the text, so that rows that share a doc_id
    keep bitmaps of their own. Line n is bit n % 64 of word n div 64; a set bit says that the line goes.
    """
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    ).select("doc", "row", "pos", F.btrim("line", F.lit(BLANK)).alias("line"))
    key = F.translate("line", UPPER, LOWER)
    lines = lines.where(F.char_length("line") >= min_chars).select("doc", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    lines = materialize(lines, "lines")
    total = lines.count()
    salts = max(32, -(-total // SALT_ROWS))
    salted = lines.select("h1", "h2", "doc", "pos", F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("salt")).repartitionByRange("h1", "h2", "salt")
    before = F.lag("doc").over(Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos"))
    firsts = salted.select("h1", "h2", "doc", F.coalesce(before != F.col("doc"), F.lit(True)).alias("first"))
    keys = firsts.groupBy("h1", "h2").agg(F.count_if("first").alias("n"), F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("lines"))
    keys = materialize(keys.where(F.col("n") >= min_docs).select("h1", "h2", "keeper", (F.col("lines") * HOT > total).alias("hot")), "keys")
    hot = F.broadcast(keys.where("hot").select("h1", "h2", "keeper"))
    rest = lines.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(keys.where("NOT hot").select("h1", "h2", "keeper"), ["h1", "h2"])
    gone = lines.join(hot, ["h1", "h2"]).unionByName(rest).where(F.col("doc") != F.col("keeper"))
    words = gone.groupBy("doc", "row", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its text rid of repeated lines, and n_lines and n_dropped.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at least
    `min_chars` code points that `min_docs` documents hold loses all its lines but those in the largest
    doc_id that holds it. A null or empty text is one empty line. All rows without doc_id are one document,
    which comes before all others. Rows that share a doc_id count as one document and stay apart in the
    result. An empty table gives an empty result. Other columns of docs pass through, whatever their names
    (those called n_lines or n_dropped are replaced).
    """
    bitmaps = line_bitmaps(docs, min_chars, min_docs)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]).alias("rest"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("row"),
    )
    joined = whole.join(bitmaps, ["doc", "row"], "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> coalesce(bit_get(try_element_at(gone, i div 64), i % 64), 0) = 0), '\\n')")
    done = joined.select(
        "rest",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(map_values(gone), 0L, (a, x) -> a + bit_count(x))"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return done.select("rest.*", "text", "n_lines", "n_dropped")
