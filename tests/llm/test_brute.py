"""Operators against brute force, the library, or held-out labels."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import exact_topk, license_scan, line_dedup, mixing, pii_crf, piece_bpe, quality_fm, queries, simhash, substring_dedup, vectors, vptree
from sensorloom.llm.components import connected

SF = "/root/testdata/sf0.001"


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")


def test_pieces_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        table = piece_bpe.PieceTable(f.read())
    lib = spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    marks = " ▁  ab\t\n.,<0x41>s'“éñ漢字日本語ありがとう👍🏽नमस्ते\x00\x85²Ⅳ_1239(){};==//  "
    texts = ["", " ", " " * 50, "▁▁ x", "<s>", *("".join(rng.choice(marks) for _ in range(rng.choice([1, 3, 8, 40]))) for _ in range(3000))]
    for text in texts:
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert table.encode(text) == ids and table.decode(ids) == lib.decode(ids)


def test_base_spans_equal_plain_patterns():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def holds(kind, got):
        n = len(re.sub("[^0-9]", "", got))
        return (True, all(int(p) <= 255 for p in got.split(".")) if kind == 1 else True, 16 <= n <= 19 and pii_crf.luhn(re.sub("[^0-9]", "", got)), 8 <= n <= 15)[kind]

    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+-() 9Zé0") for _ in range(rng.choice([5, 12, 40])))
        assert pii_crf.base_spans(text) == [(k, *m.span()) for k, p in enumerate(plain) for m in re.finditer(p, text) if holds(k, m.group())]


@pytest.fixture(scope="module")
def field(spark):
    return pii_crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def added(field, text):
    return [(pii_crf.KINDS[k], text[s:e]) for k, s, e in field.added(text, pii_crf.base_spans(text))]


def test_field_adds_what_patterns_miss(field):
    text = "call (614) 555-8001 now, or 4532-1234-5678-9012. In 2024 there were 35 items and 12.5 percent"
    assert added(field, text) == [("phone", "(614) 555-8001"), ("card", "4532-1234-5678-9012")]
    assert added(field, "write to john.smith at example.com today") == [("email", "john.smith at example.com")]
    assert added(field, "mail john (at) example dot com") == [("email", "john (at) example dot com")]
    for plain in ("peer 300.1.2.3 is up", "order 1234567890123456 shipped", "on 2024-01-01 10:30 we met 1,234,567,890 people", "meet me at the. End", "ISBN 978-3-16-148410-0"):
        assert added(field, plain) == []


def test_field_reads_long_tokens_and_texts(field):
    """Nothing is cut: neither after letters in one token, nor within a long run of numbers."""
    own = "614-555-8001"
    assert added(field, "x" * 5000 + " " + own + " end") == [("phone", own)]
    many = " and ".join([own] * 300)
    assert added(field, many) == [("phone", own)] * 300
    assert added(field, "y" * 100_000 + "7" * 50_000) == []


def test_precision_and_recall_of_added_spans(field):
    """Planted writings that the patterns miss and lookalikes, with numbers and words of their own."""
    rng = random.Random(11)
    words = "the of and river quiet letter green under mountain paper seven window".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice(["anna", "li.wei", "bob_k", "maria"]) + rng.choice(["", ".03", "7"])
    host = lambda: rng.choice(["post", "mail2", "office"]) + "." + rng.choice(["example.org", "test.net"])
    real = {
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
        "email": lambda: f"{name()}{rng.choice([' at ', ' (at) '])}{host()}",
        "ip": lambda: rng.choice(["[.]", "(.)"]).join(str(rng.randrange(1, 255)) for _ in range(4)),
    }
    plain = [lambda: f"{rng.randrange(300, 999)}.{d(2)}.{d(1)}.{d(1)}", lambda: f"order {d(9)}", lambda: f"20{d(2)}-0{rng.randrange(1, 9)}-1{d(1)}", lambda: f"{d(1)},{d(3)},{d(3)},{d(3)}", lambda: f"{d(4)}{rng.choice('abcdef')}{d(9)}{rng.choice('abcdef')}{d(7)}"]
    hits = extra = planted = 0
    for _ in range(300):
        body, want = [], []
        for _ in range(3):
            body += [rng.choice(words) for _ in range(rng.randrange(4, 9))]
            if rng.random() < 0.5:
                kind = rng.choice(list(real))
                want.append((kind, real[kind]()))
                body.append(want[-1][1])
            else:
                body.append(rng.choice(plain)())
        got = added(field, " ".join([*body, rng.choice(words)]))
        planted, hits, extra = planted + len(want), hits + sum(w in got for w in want), extra + sum(g not in want for g in got)
    assert hits >= 0.9 * planted and extra <= 0.05 * hits, (planted, hits, extra)


def test_near_components(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    texts = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(12):
            own = list(base)
            own[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_components(docs).collect()}

    def print_of(text):
        w = text.split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(len(w) - 3)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for t in texts]
    assert all(got[k]["fp"] % 2**64 == p for k, p in enumerate(prints))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert [got[k]["component_id"] for k in range(len(texts))] == root and len(set(root)) < len(texts)


def test_links_across_blocks(spark):
    """Keys with more fingerprints than a block: what links is found within blocks and across them."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3).astype(np.uint64)
    flips = np.array([(np.uint64(1) << np.uint64(a)) | (np.uint64(1) << np.uint64(b)) for a in range(40, 64) for b in range(a)], np.uint64)
    fp = np.unique(np.concatenate([base[:1] ^ flips, rng.choice(base, 300) ^ (np.uint64(7) << rng.integers(0, 60, 300).astype(np.uint64))]))
    fp = fp[rng.permutation(len(fp))[:700]]
    rows = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    links = {(r["a"], r["b"]) for r in simhash.near_links(rows, block=16).collect()}
    at = {int(v): k for k, v in enumerate(fp.view(np.int64))}

    def roots(pairs):
        root = list(range(len(fp)))
        for a, b in pairs:
            x, y = root[a], root[b]
            if x != y:
                root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    assert all(near[at[a], at[b]] for a, b in links)
    assert roots([(at[a], at[b]) for a, b in links]) == roots(zip(*np.nonzero(near)))


def test_connected(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, 900), (900, 901), (3, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and got[901] == 5 and got[7] == 6


@pytest.mark.parametrize("how", [{"bucket_bytes": 20_000}, {"bucket_bytes": 3_000, "most_buckets": 4, "team": 3}])
def test_substring_against_brute(spark, how):
    """In one step of buckets, and in two."""
    docs = corpus(spark)
    window = 13
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, window, block_bytes=20_000, **how).collect()}
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k : k + window]), d)
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        assert got[d] == " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("shard_rows", [10_000, 200])
def test_vector_searches(spark, shard_rows):
    """The registered settings over sf0.1: exact results, recall, and how few rows are looked at; in one shard and in many."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.collect()
    ids, e = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    whole = np.floor(1024 * e)
    found = exact_topk.found_products(v, shard_rows=shard_rows).cache()
    top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.best(found, 10, -1).collect()}
    near = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.nearest(v, factor=1.0, shard_rows=shard_rows).collect()}
    relaxed = vptree.found_near(v, factor=queries.VP_FACTOR, shard_rows=shard_rows).cache()
    some = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.best(relaxed, 10, 1).collect()}
    # What the trees find by themselves, without what the sample gave.
    alone = {(r["query_id"], r["vec_id"]) for r in vectors.best(relaxed.where("NOT sampled"), 10, 1).collect()}
    assert vptree.nearest(v, factor=50.0, shard_rows=shard_rows).count() == len(some) == 10 * (ids % 100 == 0).sum()  # pruning never leaves a query with fewer
    hits, own, asked = 0, 0, np.flatnonzero(ids % 100 == 0)
    for k in asked:
        s, d = whole @ whole[k], np.sqrt(((e - e[k]) ** 2).sum(1))
        s[k], d[k] = -1e18, 1e18
        assert [top[ids[k], r + 1] for r in range(10)] == [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:10]]
        want = np.lexsort((ids, d))[:10]
        assert [near[ids[k], r + 1] for r in range(10)] == [(ids[j], d[j]) for j in want]
        hits += sum((ids[k], ids[j]) in some for j in want)
        own += sum((ids[k], ids[j]) in alone for j in want)
        assert all(score == d[ids == i][0] for (q, i), score in some.items() if q == ids[k])
    pairs = len(asked) * len(ids)
    looked = lambda df, of: df.where(of).agg(F.sum("looked")).first()[0] / pairs
    # The sample is a tenth of the rows, and its products count.
    assert looked(found, "sampled") == looked(relaxed, "sampled") == 0.1
    assert hits >= 0.93 * len(near) and own >= 0.93 * len(near), (hits, own)
    assert looked(found, "NOT sampled") < (0.05 if shard_rows > 2000 else 0.13) and looked(relaxed, "NOT sampled") < 0.97


def test_vectors_without_order(spark):
    """Clusters, copies and ids that are all queries: exact in both searches; whole shards are never sent."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 10, (12, 8))
    x = (centers[rng.integers(0, 12, 900)] + rng.normal(0, 0.1, (900, 8))).astype(np.float32)
    x[300:600] = x[0]
    v = spark.createDataFrame([(100 * k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float)
    w = np.floor(1024 * x)
    found = exact_topk.found_products(v, shard_rows=64, pivots=4).cache()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.best(found, 10, -1).collect()}
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in vptree.nearest(v, shard_rows=64).collect()}
    for k in range(0, 900, 37):
        s, d = w @ w[k], np.sqrt(((x - x[k]) ** 2).sum(1))
        s[k], d[k] = -1e18, 1e18
        assert [got[100 * k, r + 1] for r in range(10)] == [(100 * j, s[j]) for j in np.argsort(-s, kind="stable")[:10]]
        assert [near[100 * k, r + 1] for r in range(10)] == [100 * j for j in np.argsort(d, kind="stable")[:10]]
    assert found.agg(F.sum("looked")).first()[0] < 0.7 * 900 * 900


def test_license_base(spark):
    phrases = {label: p.split() for label, p in license_scan.BASE}
    docs = spark.createDataFrame([(1, "Released under the MIT License. mit license"), (2, "CC BY-SA 4.0 and cc by"), (3, "GNU General Public Licence"), (4, "The GNU General Public License, version 2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs.unionByName(corpus(spark).select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 3, 5) and got[2]["labels"] == "cc-by,cc-by-sa" and got[3]["labels"] == "" and got[4]["labels"] == "gpl,gpl-2.0"
    for r in corpus(spark).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"]))
        n = sum(w[k : k + len(p)] == p for p in phrases.values() for k in range(len(w)))
        assert (got[r["doc_id"] + 100]["n_words"], got[r["doc_id"] + 100]["n_base"]) == (len(w), n)


def test_license_scan_finds_every_template_of_a_file(spark):
    """A file with several licences, among ordinary words that licences also use, keeps all labels; brute force over all templates, every column."""
    rng = random.Random(4)
    plain = [w for _, w, _, _ in license_scan.postings()] + [f"w{k}" for k in range(60)]
    texts = ["under the GNU General Public License version 3. Released under the MIT License. Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0"]
    one = {label: text for label, text, _ in license_scan.TEMPLATES}
    texts.append(". ".join(one[x] for x in ("agpl", "bsd", "mpl-2.0", "unlicense", "apache-2.0", "cc-by-nc", "lgpl")))
    texts.append("free x unencumbered software released into the public domain")
    for _ in range(60):
        parts = [rng.choice(license_scan.TEMPLATES)[1].upper() for _ in range(rng.randrange(5))] + [" ".join(rng.choices(plain, k=rng.randrange(30))) for _ in range(4)]
        rng.shuffle(parts)
        texts.append(". ".join(parts))
    posted = {}
    for t, w, at, must in license_scan.postings():
        posted.setdefault(t, []).append((at, w, must))

    def expected(k, text):
        w = re.findall("[a-z0-9]+", text.lower())
        labels, base_labels, places, score = set(), set(), [], 0.0
        for t, label, base, _, n in license_scan.rules():
            for start in range(-200, len(w)):
                held = [must for at, x, must in posted[t] if 0 <= start + at < len(w) and w[start + at] == x]
                if sum(held) == sum(must for _, _, must in posted[t]) and (base or len(held) >= 0.6 * n):
                    labels.add(label)
                    score = max(score, len(held) / n)
                    if base:
                        base_labels.add(label)
                        places.append(start)
        return (k, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)

    got = sorted(tuple(r) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got[0][6] == "apache,apache-2.0,cc-by,cc-by-nc,gpl,gpl-3.0,mit" and got[2][6] == ""
    assert {"agpl", "apache-2.0", "bsd", "cc-by-nc", "lgpl", "mpl-2.0", "unlicense"} <= set(got[1][6].split(","))
    assert got == [expected(k, t) for k, t in enumerate(texts)]
    assert max(at for _, _, at, _ in license_scan.postings()) > 64
    for t in posted:
        assert any(must and w in license_scan.STRONG for _, w, must in posted[t])


def test_line_dedup_with_hot_lines(spark, monkeypatch):
    """Lines that a third of all documents hold go by broadcast, others by a shuffle: the same rule for both."""
    rng = random.Random(9)
    monkeypatch.setattr(line_dedup, "HOT", 10)
    common = ["A line that very many documents hold", "  another line of the same KIND, longer  "]
    texts = []
    for k in range(400):
        own = [f"line number {rng.randrange(150)} of the middle kind" for _ in range(3)] + ["short", f"only in document {k} and nowhere else"]
        texts.append("\n".join(rng.sample(own + rng.sample(common, rng.randrange(3)) * 2, len(own))))
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\v\f\r"))
    holders = {}
    for d, t in enumerate(texts):
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    gone = lambda d, x: len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != d
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        lines = t.split("\n")
        left = [x for x in lines if not gone(d, x)]
        assert got[d] == ("\n".join(left), len(lines), len(lines) - len(left))


def test_mixture_hits_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mixture_report(docs).collect())) for _ in range(2))
    assert a == b
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = {}, {}
    for doc_id, size, whole, want, took in a:
        assert took <= 3 * size
        taken[source[doc_id]] = taken.get(source[doc_id], 0) + took
        target[source[doc_id]] = want
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_null_and_value_are_different_units(spark):
    docs = spark.createDataFrame([(1, "alpha beta", None), (1, None, "alpha beta"), (2, "x y z", "s")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in mixing.mixture_report(docs).collect())
    # Sources: alpha beta (weight 1, no words), s (2), null (3).
    assert got == [(1, 0, 0, 0.0), (1, 2, 2, 3.0), (2, 3, 3, 2.0)]


def test_many_sources_go_in_bins(spark, monkeypatch):
    """Bins of sources and sources above the bound: every draw is given once, in shards of the same size."""
    monkeypatch.setattr(mixing, "BIN_DRAWS", 5)
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 400, "hot").otherwise((F.col("id") % 200).cast("string")).alias("source"))
    dealt, draws = mixing.mix(docs, block_docs=2, shard_draws=16)
    draws = draws.cache()
    n = draws.count()
    assert draws.select("doc_id", "row", "epoch").distinct().count() == n
    sizes = [r["count"] for r in draws.join(dealt, ["doc_id", "row"]).select("shard", "sid", "blk", "epoch").distinct().groupBy("shard").count().collect()]
    assert len(sizes) > 5 and max(sizes) - min(sizes) <= 2
    report = mixing.mixture_report(docs, block_docs=2, shard_draws=16).collect()
    assert sum(r["taken"] for r in report) == 4 * n and all(r["taken"] <= 12 for r in report)


def test_splitting_tree_is_exact():
    counts = np.array([70, 0, 13, 200, 1])
    parts = [mixing.split_path(s, 7, counts, 5) for s in range(7)]
    assert (sum(n for _, n in parts) == counts).all()
    for k in range(5):
        spans = sorted((int(a[k]), int(a[k] + n[k])) for a, n in parts if n[k])
        assert [x for a, b in spans for x in range(a, b)] == list(range(counts[k]))
    rows = list(mixing.split_bin({4: 70, 9: 13, 2: 1}, [(s, 12) for s in range(7)], [1]))
    assert all(sum(b - a for s, _, a, b in rows if s == shard) == 12 for shard in range(7))
    for sid, n in ((4, 70), (9, 13), (2, 1)):
        assert [x for _, k, a, b in rows if k == sid for x in range(a, b)] == list(range(n))


def test_draws_beyond_the_generators_range():
    """Inversion agrees with the mean and spread of the distribution, and stays possible."""
    rng = np.random.default_rng(3)
    got = np.array([mixing.drawn(rng, 6 * 10**8, 7 * 10**8, 1000) for _ in range(4000)])
    assert abs(got.mean() - 1000 * 6 / 13) < 1 and abs(got.std() / (1000 * 42 / 169) ** 0.5 - 1) < 0.05
    big = mixing.drawn(rng, 5 * 10**11, 5 * 10**11, 4 * 10**9)
    assert abs(big - 2 * 10**9) < 10 * (10**9) ** 0.5
    assert mixing.drawn(rng, 10**10, 1, 10**10) in (10**10 - 1, 10**10)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_fm.classify(docs.select("doc_id", "text"), labels).withColumn("out", quality_fm.held_out("doc_id")).join(labels, "doc_id").where("out").collect()
    good = [r["predicted"] == r["quality"] for r in got]
    assert len(good) > 50 and np.mean(good) > 0.9 and np.mean([r["predicted"] for r in got if r["quality"] == 1]) > 0.97


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    rows = pipeline.run(spark, SF)
    assert rows.count() == docs.count() > 50


def rows_of(df, columns=None):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_pipeline_rows_equal_brute_force(spark):
    """Each stage's rows, from what the stage before returned, and those of the whole run."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spm = pytest.importorskip("sentencepiece")
    stage = dict(pipeline.STAGES)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    at = {c: k for k, c in enumerate(docs.columns)}

    def after(name, given):
        return rows_of(stage[name](spark, spark.createDataFrame(given, docs.schema), SF))

    # Quality: the machine's score with all pairs written out.
    machine, given = quality_fm.train(docs, labels), rows_of(docs)
    x = ((quality_fm.features([(r[at["text"]] or "").encode() for r in given]) - machine.mean) / machine.scale).astype(float)
    pairs = machine.factors.astype(float) @ machine.factors.astype(float).T
    np.fill_diagonal(pairs, 0)
    score = 1 / (1 + np.exp(-np.clip(machine.bias + x @ machine.linear + 0.5 * np.einsum("ri,ij,rj->r", x, pairs, x, optimize=True), -30, 30)))
    got = after("quality classifier", given)
    assert got == [r for r, s in zip(given, score) if s >= 0.3] and 0 < len(got) < len(given)

    # Lines: of a line in three documents or more, the one in the largest doc_id stays.
    given, holders = got, {}
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\v\f\r"))
    for r in given:
        for line in r[at["text"]].split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r[at["doc_id"]])
    want = []
    for r in given:
        lines = r[at["text"]].split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r[at["doc_id"]]]
        own = {"text": "\n".join(left), "n_chars": len("\n".join(left))} if len(left) < len(lines) else {}
        want.append(tuple(own.get(c, r[at[c]]) for c in docs.columns))
    got = after("line dedup", given)
    assert got == sorted(want, key=repr) and got != given

    # Near copies: all pairs of fingerprints.
    given, prints = got, []
    for r in given:
        w = r[at["text"]].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    root = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for k, r in enumerate(given):
        least[root[k]] = min(least.get(root[k], r[at["doc_id"]]), r[at["doc_id"]])
    got = after("SimHash near-dedup", given)
    assert got == [r for k, r in enumerate(given) if r[at["doc_id"]] == least[root[k]]] and len(got) < len(given)

    # Mixing: a draw, so what holds of every draw. Whole rows only, each at most three times and as often as the
    # others of its source, or once more; words miss a source's target by less than one row's.
    given = got
    got = after("mixing to target weights", given)
    size = {r: len((r[at["text"]] or "").encode().split()) for r in given}
    times = {r: got.count(r) for r in given}
    assert sum(times.values()) == len(got)
    sources = sorted({r[at["source"]] for r in given})
    have = {s: sum(n for r, n in size.items() if r[at["source"]] == s) for s in sources}
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}, set(sources)
    while free:
        level = (sum(have.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * have[s]}
        target |= {s: 3 * have[s] for s in full} if full else {s: weight[s] * level for s in free}
        free = free - full if full else set()
    for s in sources:
        n = [times[r] for r in given if r[at["source"]] == s and size[r]]
        assert max(n) <= 3 and max(n) - min(n) <= 1
        assert abs(sum(size[r] * times[r] for r in given if r[at["source"]] == s) - target[s]) < max(size[r] for r in given if r[at["source"]] == s)

    # Tokens: the library.
    import hashlib

    import public_tokenizers

    lib = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in got:
        ids = lib.encode(r[at["text"]] or "", add_bos=True, add_eos=True)
        raw, text = np.array(ids, "<u4").tobytes(), lib.decode(ids)
        want.append((r[at["doc_id"]], raw, text, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    columns = ["doc_id", "packed", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    last = stage["SentencePiece"](spark, spark.createDataFrame(got, docs.schema), SF)
    assert last.columns == columns and rows_of(last) == sorted(want, key=repr)
    assert rows_of(pipeline.run(spark, SF), columns) == sorted(want, key=repr)


def test_registered_queries_against_brute_force(spark):
    """The digests and columns of the queries that have no SQL, from their registered functions."""
    import hashlib

    spm = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    every = queries.queries()
    texts = {r["doc_id"]: r["text"] or "" for r in corpus(spark).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {r["doc_id"]: r for r in every["op3_pii_crf"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        base = pii_crf.base_spans(t)
        names = [f"{pii_crf.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert got[d]["base_sha256"] == sha(",".join(names).encode()) and set(names) <= set(got[d]["spans"].split(",")) | {""}
        assert [got[d][f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[0] == k for x in base) for k in range(4)]
        assert got[d]["n_spans"] == len([x for x in got[d]["spans"].split(",") if x])
    lib = spm.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    for r in every["op10_sentencepiece"](spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode()))
    for r in every["op7_simhash"](spark, SF).collect():
        w = texts[r["doc_id"]].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        assert int(r["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    import zlib

    scored = every["op8_quality_fm"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in scored)
    assert {r["doc_id"] for r in scored} == set(texts)
    mixed = {r["doc_id"]: r for r in every["op4_mixing"](spark, SF).collect()}
    assert all(mixed[d]["size"] == len(t.encode().split()) and mixed[d]["taken"] % max(1, mixed[d]["size"]) == 0 for d, t in texts.items())
