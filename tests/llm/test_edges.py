"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import exact_topk, license_scan, line_dedup, merkle, mixing, pii_crf, piece_bpe, quality_fm, simhash, substring_dedup, vptree, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{k}" for k in range(40))
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
DOCS = [
    (1, WORDS, "en", "a", 1), (2, f"intro {WORDS} outro", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, WORDS, "en", "b", 1),
    (5, LONG, "en", "b", 1), (6, " \t\n ", "en", None, 1), (7, WORDS, "en", "a", 1), (7, WORDS, "en", "a", 1), (8, "Übergröße naïve ▁x\n\nß", "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(1) for c in ("row", "pos", "line", "h1", "block", "shard", "fp", "size", "score", "hits", "gone", "rest", "epoch", "uid", "v", "__text", "none", "team", "bin", "cell", "part", "grp", "c", "p", "g", "limit")}
    return spark.createDataFrame(DOCS, SCHEMA).withColumns(clash).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def model(name="piece_bpe_32k.model"):
    return pytest.importorskip("public_tokenizers").path(name)


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (5, 0), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")


OPERATORS = {
    "substring": lambda d: substring_dedup.remove_repeats(d),
    "pii": lambda d: pii_crf.find_personal_data(d),
    "mixing": lambda d: mixing.mixture_report(d),
    "license": lambda d: license_scan.scan(d),
    "simhash": lambda d: simhash.near_components(d),
    "quality": lambda d: quality_fm.classify(d, labels(d.sparkSession)),
    "lines": lambda d: line_dedup.drop_repeated_lines(d),
    "pieces": lambda d: piece_bpe.digests(d, model()),
    "manifest": lambda d: merkle.manifest(d),
    "words": lambda d: word_bpe.encode_decode(d, model("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(name, docs, empty):
    got = OPERATORS[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d[0] is None, d[0] or 0) for d in DOCS)
    assert OPERATORS[name](empty).count() == 0


def test_substring(docs):
    got = {(r["doc_id"]): r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 40 and got[2]["text"] == "intro outro"
    assert got[7]["n_removed"] == 40 and got[None]["n_removed"] == 40 and got[3]["n_words"] == 0
    assert got[5]["n_words"] == 30_000 and got[5]["n_removed"] == 0  # repeats within a document stay


def test_simhash_components(docs):
    got = {r["doc_id"]: r for r in simhash.near_components(docs).collect()}
    assert got[7]["component_id"] == 1 and got[None]["component_id"] == 1
    assert got[3]["fp"] == 0 and got[4]["component_id"] == 3 and got[6]["component_id"] == 3
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect() if r["doc_id"] != 8) == sorted({-1, 1, 2, 3, 5} - ({2} if got[2]["component_id"] == 1 else set()))


def test_lines_keep_other_columns(spark, docs):
    got = line_dedup.drop_repeated_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    # WORDS is a line of documents 1, 7 and the one without id: it stays in 7 alone.
    assert by[1]["n_dropped"] == 1 and by[1]["text"] == "" and by[None]["n_dropped"] == 1 and by[7]["n_dropped"] == 0
    assert by[3]["n_lines"] == 1 and by[6]["n_lines"] == 2 and by[8]["n_lines"] == 3


def test_mixing_repeats_rows(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = mixing.mixture_report(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken = sum(r["taken"] for r in rows)
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == taken


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_fm.classify(docs, none).collect()} == {0.5}


VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.5, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, [0.25]), (None, [1.0, 1.0]), (7, [1e30, 0.0]), (8, [])]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("uid", "v", "shard", "grp", "h", "score", "rank", "cell", "part", "c", "p", "g", "t", "limit", "cells", "looked")})
    top = exact_topk.top_products(v, top=3).orderBy("query_id", "rank").collect()
    assert len(top) == 9 and [r["vec_id"] for r in top if r["query_id"] == 100] == [7, 0, 0]
    near = vptree.nearest(v, top=3).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in near if r["query_id"] == 0 and r["rank"] == 1] == [(0, 0.0)] * 2
    assert 5 not in {r["vec_id"] for r in near} and 8 not in {r["vec_id"] for r in near}
    none = v.where("vec_id > 1000")
    assert exact_topk.top_products(none).count() == 0 and vptree.nearest(none).count() == 0


def test_ids_that_are_all_queries(spark):
    """Groups are sized by the queries that there are, not by a share of the rows."""
    v = spark.range(500).select((F.col("id") * 100).alias("vec_id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"))
    assert exact_topk.top_products(v, top=2).count() == 1000 and vptree.nearest(v, top=2).count() == 1000


def test_largest_long_is_an_id(spark):
    docs = spark.createDataFrame([(2**63 - 1, WORDS), (None, WORDS), (1, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert set(got) == {2**63 - 1, None, 1}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from sensorloom.llm import common

    class Elsewhere:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere())
