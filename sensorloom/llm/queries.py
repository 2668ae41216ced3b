"""The registered queries of the corpus operators and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, hard_negatives, license_scan, line_dedup, merkle, mixing, pii_crf, piece_bpe, quality_fm, simhash, substring_dedup, vptree, word_bpe

SPACE = r"[^\x20\x09-\x0D]+"


#: Pruning factor of the vantage-point trees; measured recall with it: see README.
VP_FACTOR = 5.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM starts
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p
  FROM windows JOIN firsts USING (s) WHERE first_doc < doc_id
), dropped AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, w,
         CASE WHEN ps IS NULL THEN w
              ELSE list_filter(list_transform(generate_series(1, len(w)), lambda i: CASE WHEN list_contains(ps, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL) END AS k
  FROM words LEFT JOIN dropped ON words.doc_id = dropped.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"), every=100, top=10)


OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.n AS qn, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.n <> c.n WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, qn ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), every=100, top=10, factor=VP_FACTOR)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_fm.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_fm.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), kept AS (
  SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    rows = merkle.manifest(docs, extra={"tampered": F.when(hit, merkle.leaf_of(tampered))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def field(value: str) -> str:
    """SQL of a value as a leaf's digest takes it."""
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


# The numbers are those of the usual CRC-32: its polynomial and its mask.
OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || {field("n_chars")} || {field("text")}) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || {field("n_chars + 1")} || {field("text")}) END AS tampered
  FROM (SELECT *, {field("doc_id")} || {field("source")} || {field("lang")} AS head FROM docs)
), nodes AS (
  SELECT 0 AS lvl, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lvl, lang, pos // 2
), subroots AS (
  SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, hash, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2
), placed AS (
  SELECT doc_id, l.lang, leaf, tampered, row_number() OVER (PARTITION BY l.lang ORDER BY doc_id) - 1 AS pos, s.hash AS subroot, s.pos AS place
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
), steps AS (
  SELECT doc_id, n.lvl, (p.pos >> n.lvl) & 1 AS own, s.hash AS sibling
  FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = p.pos >> n.lvl AND n.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = n.lvl AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT doc_id, 1000 + t.lvl, (p.place >> t.lvl) & 1, s.hash
  FROM placed p JOIN tops t ON t.pos = p.place >> t.lvl AND t.n > 1 LEFT JOIN tops s ON s.lvl = t.lvl AND s.pos = xor(t.pos, 1)
), paths AS (
  SELECT doc_id, list({{'own': own, 'sibling': coalesce(sibling, '')}} ORDER BY lvl) AS path FROM steps GROUP BY doc_id
), folded AS (
  SELECT placed.*, coalesce(path, []) AS path, (SELECT hash FROM tops WHERE n = 1) AS root,
         list_reduce(list_prepend({{'own': 0, 'sibling': coalesce(tampered, leaf)}}, coalesce(path, [])),
           lambda a, s: {{'own': 0, 'sibling': CASE WHEN s.own = 0 THEN sha256(a.sibling || s.sibling) ELSE sha256(s.sibling || a.sibling) END}}).sibling AS folded_root
  FROM placed LEFT JOIN paths USING (doc_id)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.sibling), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100, positives=5, negatives=5, least=0.8, scale=256.0)


OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS n, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT a.n AS an, a.vec_id AS anchor_id, c.n AS cn, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors c ON a.n <> c.n WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) AS k FROM pairs WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, c.vec_id AS negative_id, p.score AS positive_score, c.score AS negative_score,
         row_number() OVER (PARTITION BY p.an, p.cn ORDER BY c.score DESC, c.vec_id) AS rank
  FROM positives p JOIN pairs c ON p.an = c.an AND NOT c.same AND 80 * p.score <= 100 * c.score AND c.score <= p.score
  WHERE p.k <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = word_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_exact_topk": op2_exact_topk,
        "op3_pii_crf": op3_pii_crf,
        "op4_mixing": op4_mixing,
        "op5_license_scan": op5_license_scan,
        "op6_vptree": op6_vptree,
        "op7_simhash": op7_simhash,
        "op8_quality_fm": op8_quality_fm,
        "op9_line_dedup": op9_line_dedup,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_merkle": op11_merkle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_word_bpe": op13_word_bpe,
    }


def oracle_sql() -> dict:
    return {"op1_substring_dedup": OP1_SQL, "op2_exact_topk": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle": OP11_SQL, "op12_hard_negatives": OP12_SQL}
