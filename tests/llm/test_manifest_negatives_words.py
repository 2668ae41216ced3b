"""The manifest, hard negatives and word-end encoding against brute force and the library."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import hard_negatives, merkle, queries, word_bpe

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan):
    """The root, and (left, right) siblings of each node from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            lo = at[i] // fan * fan
            run = nodes[lo : lo + fan]
            path.append(("".join(run[: at[i] - lo]), "".join(run[at[i] - lo + 1 :])))
            at[i] //= fan
        nodes = [digest(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
    return nodes[0], paths


def expected(rows, fan):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text), in any order."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[2] == lang))
        held.append((mine, *tree([m[2] for m in mine], fan)))
    root, above = tree([h[1] for h in held], fan)
    return sorted((repr(m[1] if m[0] else None), m[2], sub, root, tuple(p + up)) for (mine, sub, paths), up in zip(held, above) for m, p in zip(mine, paths))


def got(df):
    return sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"])) for r in df.collect())


ROWS = [(None, "a", None, None, None), (None, "a", None, None, None), (3, "b", "", 0, ""), (3, "b", "", 0, ""), (-7, None, "é", 5, "Ünï\n"), *((k, "s", "zz", k, f"t{k}") for k in range(37, 0, -1))]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fan, height", [(2, 1), (2, 2), (2, 8), (3, 2), (5, 4)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, fan, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    clash = {c: F.lit(1) for c in ("tree", "at", "span", "n", "pos", "total", "hash", "block", "top", "path", "root", "leaf")}
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns(clash).repartition(5)
    assert got(merkle.manifest(docs, fan=fan)) == expected(ROWS, fan)


def test_manifest_of_none_and_of_one(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    only = (1, "s", "en", 3, "abc")
    (row,) = merkle.manifest(spark.createDataFrame([only], SCHEMA)).collect()
    assert row["path"] == [] and row["leaf"] == row["subroot"] == row["root"] == leaf(only)
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([only], SCHEMA), fan=1)


def test_manifest_query_folds_tampered_leaves(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    by = {r[0]: r for r in rows}
    want = {eval(w[0]): w for w in expected(rows, 2)}
    found = queries.op11_merkle(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        d, (_, own, sub, root, path) = by[r["doc_id"]], want[r["doc_id"]]
        moved = zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
        folded = leaf((*d[:3], d[3] + 1, *d[4:])) if moved else own
        for left, right in path:
            folded = digest(left, folded, right)
        assert tuple(r) == (d[0], own, sub, root, digest(*[a + b for a, b in path]), folded, folded == root)
        assert r["verified"] != moved


@pytest.mark.parametrize("name", ["op11_merkle", "op12_hard_negatives"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, SF)
    assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(want.fetchall())


def mined(rows, every, scale, positives=5, negatives=5, least=0.8):
    """Rows (vec_id, vector, label) by brute force; equal rows may take each other's places."""
    good = [(i, np.floor(scale * np.array(v, np.float32).astype(float)), x) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]

    def score(a, b):
        n = min(len(a), len(b))
        return float(a[:n] @ b[:n])

    out = []
    for k, (i, v, x) in enumerate(good):
        if i % every:
            continue
        others = sorted(((-score(v, w), j, y) for m, (j, w, y) in enumerate(good) if m != k), key=lambda t: t[:2])
        for p, j, _ in [t for t in others if t[2] == x][:positives]:
            fits = [t for t in others if t[2] != x and least * -p <= -t[0] <= -p][:negatives]
            out += [(i, j, r, t[1], int(-p), int(-t[0])) for r, t in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(3, 10))
    rows = [(k, (centre[k % 3] + rng.normal(size=10) * 0.4).tolist()[: 10 if k % 11 else 7], k % 4) for k in range(400)]
    rows += [(400, rows[100][1], 0), (400, rows[100][1], 1), (100, rows[100][1], 0)]  # ids twice, equal vectors, ties
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [NAN], 1), (800, [INF], 1), (900, [1.0], None), (None, [1.0] * 10, 1), (1000, [], 2), (1100, [0.0] * 10, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("uid", "v", "t", "part", "grp", "score", "rank", "rows", "asks", "parts", "groups")})
    want = mined(rows, 20, 256.0)
    assert len(want) > 200
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, every=20).collect())) == want
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 50)  # several parts of a label, several groups of anchors
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 4)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, every=20).collect())) == want
    assert hard_negatives.hard_negatives(df.where("vec_id < 0")).count() == 0


def test_summaries_bound_scores_and_prune():
    rng = np.random.default_rng(5)
    level = np.repeat(rng.normal(size=(2000, 8)), 8, axis=1)  # smooth vectors: a segment's mean says most of it
    rows = np.floor(256 * (level + rng.normal(size=(2000, 64)) * 0.05))
    table, counts = hard_negatives.summaries(rows), hard_negatives.levels_of(64)
    scores = rows @ rows[0]
    for k in range(len(counts)):
        mid, half = hard_negatives.bounds(table, table[0], k, counts)
        assert (mid - half <= scores).all() and (scores <= mid + half).all()
    high = np.sort(scores)[-10:-5].copy()
    ats, _, looked = hard_negatives.search(rows, table, rows[0], table[0], np.ones(2000, bool), 0.8 * high, high, 5)
    for top, at in zip(high, ats):
        fits = [k for k in np.argsort(-scores, kind="stable") if 0.8 * top <= scores[k] <= top][:5]
        assert at.tolist() == fits
    assert looked < 200


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


ALPHABETS = ["a", "ab", "haha!", "lo", "abcdefghijklmnopqrstuvwxyz", "!?.-=", "the quick é ÉΣς İß 12 '", "'srevdmlt ", "漢字日本語ありがとう👍🏽नमस्ते\x00\x85²Ⅳ_(){}ֈᲉꟋ́Å"]


def texts(rng):
    yield from ("", " ", "\n\t", "<|endoftext|>", "a<|startoftext|>b <|EndOfText|>", "don't I'LL 'sun", "é É")
    for letters in ALPHABETS:
        yield from ("".join(rng.choice(letters) for _ in range(n)) for n in (1, 3, 7, 30, 65, 129, 500, 2000) for _ in range(12))


def test_words_equal_the_library(path, library):
    with open(path, encoding="utf-8") as f:
        table = word_bpe.MergeTable(f.read())
    for text in texts(random.Random(8)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert table.encode(text).tolist() == ids
        assert table.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_joins_grow_until_both_sides_agree(path, library):
    """Any cut of a word, however short its halves, gives the whole word's tokens."""
    with open(path, encoding="utf-8") as f:
        table = word_bpe.MergeTable(f.read())
    rng = random.Random(9)
    for letters in ("a", "ab", "aeinorst", "xyzzyx", "ha"):
        for _ in range(150):
            symbols = table.symbols("".join(rng.choice(letters) for _ in range(rng.randrange(2, 90))))
            cut = rng.randrange(1, len(symbols))
            whole = table.merged_many(symbols)
            assert whole == table.merged_few(symbols) == table.joined(table.merged(symbols[:cut]), table.merged(symbols[cut:]))


def test_long_unsplit_texts_are_dealt_over_tasks(spark, path, library):
    rng = random.Random(10)
    long = ["".join(rng.choice(a) for _ in range(700)) for a in ("ab", "a", "abcdefghij", "漢字", "!-")]
    docs = [(k, t) for k, t in enumerate([*long, f"in front {long[2]} <|endoftext|>{long[0]}<|startoftext|> and after", long[0], None, "", "short words only"])] + [(0, long[0]), (None, long[1])]
    got = word_bpe.encode_decode(spark.createDataFrame(docs, "doc_id long, text string"), path, run=100, piece=32).collect()
    assert len(got) == len(docs)
    want = sorted((repr(k), library.encode(t or "", add_special_tokens=False).ids) for k, t in docs)
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in got)


def test_word_query_equals_the_library(spark, path, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op13_word_bpe(spark, SF).collect())) == sorted(want)


def test_other_files_are_refused(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert os.path.exists(path)
    with pytest.raises(ValueError, match="word ends"):
        word_bpe.encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
