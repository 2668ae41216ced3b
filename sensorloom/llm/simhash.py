"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits form a ring of m = 5 segments. If two fingerprints differ in at most 4 bits, some
segment starts a chain whose first l segments differ in at most l * 4 / 5 bits, for every l: none in the
first, at most one in the first two, and so on round the ring. Fingerprints therefore meet on keys made of a
segment's bits and the next segment's with one bit masked; the rest of the chain prunes before all 64 bits
are compared. Equal fingerprints are one row from the start, so a group of exact copies costs one row.

A key's fingerprints are linked by a spanning forest, never by all pairs: a sorted partition is streamed, and
a key with more fingerprints than a block holds is cut into blocks whose pairs are dealt to further tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, small_batches
from .components import connected

U64 = np.uint64
CUTS = (0, 13, 26, 39, 52, 64)  # the ring's segments
MOST = 4  # differing bits that still link
RING = len(CUTS) - 1
SEGMENT = [sum(1 << k for k in range(CUTS[i], CUTS[i + 1])) for i in range(RING)]
BLOCK = 2048  # fingerprints of a key that one task compares at once


def fingerprints_of(texts: list[str | None], size: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    digest, each = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if len(words) <= size:
            each.append(np.array([digest(b" ".join(words), 42)] if words else [], U64))
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - size + 1
        each.append(np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())], U64, n))
    out = np.zeros(len(texts), U64)
    weights = U64(1) << np.arange(64, dtype=U64)
    for k, h in enumerate(each):
        if len(h):
            ones = np.zeros(64, np.int64)
            for lo in range(0, len(h), 65536):
                ones += np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = weights[ones * 2 > len(h)].sum(dtype=U64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fingerprints_of(list(part["text"])).view(np.int64)})

    rows = pick(small_batches(docs), doc_id="doc_id", text="text").select(F.col("doc_id").cast("string"), "text")  # pandas would round ids beside nulls
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long"), "fp")


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their fingerprints: segment i, the masked bit of the next one, and the bits of both."""
    keys, every = [], []
    for i in range(RING):
        j = (i + 1) % RING
        first = (fp & U64(SEGMENT[i])) >> U64(CUTS[i])
        second = (fp & U64(SEGMENT[j])) >> U64(CUTS[j])
        for bit in range(CUTS[j + 1] - CUTS[j]):
            masked = second & ~(U64(1) << U64(bit))
            keys.append(U64((i << 44) | (bit << 40)) | (first << U64(20)) | masked)
            every.append(fp)
    return np.concatenate(keys), np.concatenate(every)


def chain_masks(i: int) -> list[tuple[np.uint64, int]]:
    """The bits of the first l segments from i on, and their budget."""
    out, mask = [], 0
    for length in range(1, RING + 1):
        mask |= SEGMENT[(i + length - 1) % RING]
        out.append((U64(mask), length * MOST // RING))
    return out


CHAINS = [chain_masks(i) for i in range(RING)]


def linked(difference: np.ndarray, i: int) -> np.ndarray:
    """Which differences keep every budget of the chain from segment i; the last one is the full check."""
    good = np.bitwise_count(difference & CHAINS[i][0][0]) <= CHAINS[i][0][1]
    for mask, most in CHAINS[i][1:]:
        at = np.flatnonzero(good)
        good[at] = np.bitwise_count(difference[at] & mask) <= most
    return good


def forest(fp: np.ndarray, i: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what the chain from segment i links: a spanning forest."""
    left, out = np.unique(fp), []
    queue: list = []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        good = linked(left ^ node, i)
        if good.any():
            found, left = left[good], left[~good]
            out.append((np.full(len(found), node), found))
            queue.extend(found)
    return out


def larger(batches: Iterator[pd.DataFrame], rows: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of batches, gathered until there are so many."""
    keys, prints, n = [], [], 0
    for pdf in batches:
        keys.append(pdf["key"].to_numpy(np.int64))
        prints.append(pdf["fp"].to_numpy(np.int64).view(U64))
        n += len(pdf)
        if n >= rows:
            yield np.concatenate(keys), np.concatenate(prints)
            keys, prints, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(prints)


EDGES = "kind int, a long, b long, key long, blk int"


def link_runs(batches: Iterator[pd.DataFrame], block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by key: links within keys (kind 0), and the blocks of keys that are too large (kind 1)."""
    key, fp = np.empty(0, np.int64), np.empty(0, U64)
    cut_key, number = None, 0

    def frame(kind, a, b, keys=None, blk=0):
        n = len(a)
        return pd.DataFrame({"kind": np.full(n, kind, np.int32), "a": a.view(np.int64), "b": b.view(np.int64), "key": np.zeros(n, np.int64) if keys is None else keys, "blk": np.full(n, blk, np.int32)})

    def run_of(k: int, values: np.ndarray, cut: bool):
        for a, b in forest(values, k >> 44):
            yield frame(0, a, b)
        if cut:
            yield frame(1, values, np.zeros(len(values), U64), np.full(len(values), k, np.int64), number)

    def flush(key, fp, last):
        """All runs of the arrays but, unless it is the end, the last; gives back what is left."""
        nonlocal cut_key, number
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([starts[1:], [len(key)]])
        done = len(starts) if last else len(starts) - 1
        sizes = (ends - starts)[:done]
        fewer = np.repeat(sizes <= 8, sizes)
        if cut_key is not None and done and key[0] == cut_key:
            fewer[: sizes[0]] = False
        k, f = key[: len(fewer)][fewer], fp[: len(fewer)][fewer]
        for step in range(1, 8):
            if len(k) <= step:
                break
            at = np.flatnonzero(k[step:] == k[:-step])
            if not len(at):
                break
            x, segment = f[at] ^ f[at + step], k[at] >> 44
            for i in range(RING):
                own = np.flatnonzero(segment == i)
                hit = at[own[linked(x[own], i)]]
                if len(hit):
                    yield frame(0, f[hit], f[hit + step])
        for s, e in zip(starts[:done], ends[:done]):
            going_on = cut_key is not None and key[s] == cut_key
            if e - s <= 8 and not going_on:
                continue
            number = number if going_on else 0
            whole = e - s <= block and not going_on
            for lo in range(s, e, block):
                yield from run_of(int(key[s]), fp[lo : min(lo + block, e)], not whole)
                number += 1
            if going_on:
                cut_key = None

    for more_keys, more_prints in larger(batches):
        key, fp = np.concatenate([key, more_keys]), np.concatenate([fp, more_prints])
        yield from flush(key, fp, False)
        start = np.searchsorted(key, key[-1]) if (key[:-1] <= key[1:]).all() else np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1]
        key, fp = key[start:], fp[start:]
        while len(key) >= 2 * block:  # one key goes on and on: its blocks leave
            if cut_key != key[0]:
                cut_key, number = key[0], 0
            yield from run_of(int(key[0]), fp[:block], True)
            number += 1
            key, fp = key[block:], fp[block:]
    if len(key):
        yield from flush(key, fp, True)


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links that join every two fingerprints of distinct(fp) that differ in at most MOST bits, and only such."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                key, fp = ring_keys(pdf["fp"].to_numpy(np.int64)[lo : lo + 4096].view(U64))
                yield pd.DataFrame({"key": key.view(np.int64), "fp": fp.view(np.int64)})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        found = forest(pdf["fp"].to_numpy(np.int64).view(U64), int(pdf["key"].iloc[0]) >> 44)
        a, b = (np.concatenate([x[k] for x in found] or [np.empty(0, U64)]) for k in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = distinct.select("fp").mapInPandas(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(rows.mapInPandas(lambda batches: link_runs(batches, block), EDGES), "near")
    cut = found.where("kind = 1").select("key", "blk", F.col("a").alias("fp"))
    blocks = cut.groupBy("key").agg(F.max("blk").alias("last"))
    dealt = cut.join(blocks, "key").select("key", "fp", "blk", F.explode(F.sequence(F.lit(0), "last")).alias("other")).where("blk != other")
    more = dealt.select("key", "fp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).groupBy("key", "i", "j").applyInPandas(across, "a long, b long")
    return found.where("kind = 0").select("a", "b").union(more).distinct()


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text).

    Fingerprints that differ in at most 4 bits link; component_id is the smallest doc_id that a row reaches,
    itself included (null where it reaches only rows without doc_id). A null text is an empty one: its
    fingerprint is zero, and links like any other. Repeated rows and ties share a component. An empty table
    gives an empty result. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(near_links(distinct, block))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, and all rows without doc_id.

    Rows that share a doc_id stay or go together. Columns pass through, whatever their names.
    """
    gone = near_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").cast("long").alias("__id"))
    return whole.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__doc.*")
