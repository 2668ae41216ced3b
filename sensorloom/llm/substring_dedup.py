"""Substring dedup by difference-cover anchors.

A run of `window` words that stands in two documents at offsets i and j is found without hashing every
offset: D is a difference cover modulo v, so some d < v makes both i + d and j + d cover positions, and the
anchor of `window - v + 1` words there lies within the run. Only anchors at cover positions are hashed
(3 of 7 offsets for 13 words). Anchors that stand in two documents are then extended to whole windows.

Data moves in blocks of documents. A block sends each of its distinct anchors once, as packed 32-bit values
dealt to buckets, so that a passage that a third of the corpus holds costs a bucket one value a block, never
a row a document. The reply tells the block which of its anchors other blocks hold too. In the second round
the blocks send 96-bit hashes of the windows around shared anchors with the smallest doc_id that holds them,
and get back the smallest in the corpus. Anchor values may collide, which only costs work; window hashes
decide. The texts are shuffled once, and the three passes over them read the same exchange.

Buckets grow in number with the volume of text. Where there are more of them than a block has use for, values
go in two steps: blocks deal to MOST_BUCKETS buckets, in which the rows of TEAM blocks are added up and dealt
on to the bucket's own parts; replies come back the same way. No task holds more than a block, a team's share
of a bucket, or one part.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cached_words, pick, text_volume, window_hashes

#: Perfect difference sets: modulus -> residues (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Odd multipliers of the hashes of anchors and of the two halves of a window's hash.
ANCHOR, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
NO_ID = np.iinfo(np.int64).max  # a row without doc_id comes after all others
U64 = np.uint64


def cover_for(window: int) -> int:
    """The largest modulus whose anchors still have half of the window's words."""
    return max([v for v in COVERS if window - v + 1 >= max(2, window // 2)], default=3)


class Block:
    """The documents of a block as one array of word hashes, with their cover positions' anchors."""

    def __init__(self, pdf: pd.DataFrame, window: int, cache: WordHashes):
        self.window, self.v = window, cover_for(window)
        self.size = window - self.v + 1
        pdf = pdf.sort_values("doc_id", kind="stable")
        self.ids, self.none = pdf["doc_id"].to_numpy(np.int64), pdf["none"].to_numpy(bool)
        self.words = [t.split() if t is not None else [] for t in pdf["text"]]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        n = int(self.counts.sum())
        self.hashes = np.fromiter(map(cache.__getitem__, chain.from_iterable(self.words)), U64, n)
        self.doc = np.repeat(np.arange(len(self.words), dtype=np.int32), self.counts)
        begin = np.cumsum(self.counts) - self.counts
        self.place = np.arange(n) - begin[self.doc]
        self.whole = np.flatnonzero(self.counts[self.doc] - self.place >= window)  # where a window begins

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of all documents that have a window."""
        residues = np.zeros(self.v, bool)
        residues[list(COVERS[self.v])] = True
        n = max(0, len(self.hashes) - self.size + 1)
        left = self.counts[self.doc[:n]] - self.place[:n]
        at = np.flatnonzero(residues[self.place[:n] % self.v] & (left >= self.size) & (self.counts[self.doc[:n]] >= self.window))
        return at, window_hashes(self.hashes, self.size, ANCHOR, keep=at)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors of the block, and which of them two of its documents hold; positions and hashes of all."""
        at, a = self.anchors()
        order = np.argsort(a, kind="stable")
        found, first = np.unique(a[order], return_index=True)
        last = np.concatenate([first[1:], [len(a)]])[: len(found)] - 1
        return found, self.doc[at[order[last]]] != self.doc[at[order[first]]], at, a

    def windows(self, shared: np.ndarray, at: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and both hash halves of the windows that hold a shared anchor."""
        hit = np.zeros(len(self.hashes) + 1, np.int32)
        hit[at[member(a, shared)]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        starts = self.whole[total[self.whole + self.v] > total[self.whole]]
        return self.doc[starts], window_hashes(self.hashes, self.window, FIRST, starts), short(window_hashes(self.hashes, self.window, SECOND, starts))


class Pairs:
    """A lookup of values under two hash halves."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        order = np.lexsort((b, a))
        self.a, self.b, self.value = a[order], b[order], value[order]
        # First halves that collide are looked up one by one.
        again = (self.a[1:] == self.a[:-1]).any()
        self.each = {(int(x), int(y)): int(z) for x, y, z in zip(self.a, self.b, self.value)} if again else None

    def find(self, x: np.ndarray, y: np.ndarray, missing: int) -> np.ndarray:
        if self.each is not None:
            return np.array([self.each.get((int(p), int(q)), missing) for p, q in zip(x, y)], np.int64)
        out = np.full(len(x), missing, np.int64)
        if len(self.a):
            j = np.searchsorted(self.a, x)
            j[j == len(self.a)] = 0
            hit = (self.a[j] == x) & (self.b[j] == y)
            out[hit] = self.value[j[hit]]
        return out


def short(values: np.ndarray) -> np.ndarray:
    """The low 32 bits."""
    return (values & U64(0xFFFFFFFF)).astype(np.uint32)


def by_hash(first: np.ndarray, second: np.ndarray, doc: np.ndarray, in_order: bool) -> np.ndarray:
    """The order by both hash halves and document. in_order: documents are already, so one stable sort does unless first halves collide."""
    if in_order:
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        if not ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            return order
    return np.lexsort((doc, second, first))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def dealt(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Indices by bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def upper(values: np.ndarray, buckets: int) -> np.ndarray:
    """The high half of a hash chooses the bucket."""
    return (values >> U64(32)) % U64(buckets)


def lower(values: np.ndarray, parts: int) -> np.ndarray:
    """The low half chooses the part of a bucket."""
    return (values & U64(0xFFFFFFFF)) % U64(parts)


def joined(column, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in column]])


ANCHORS = "bucket long, block long, once binary, twice binary"
SHARED = "block long, bucket long, shared binary"
WINDOWS = "bucket long, block long, first binary, second binary, docs binary, doc binary, many binary"
LEAST = "block long, bucket long, first binary, second binary, least binary"
names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def anchor_rows(found: np.ndarray, twice: np.ndarray, groups, block: int) -> pd.DataFrame:
    """A row for each bucket: its anchors in order, those of one document and those of several."""
    return pd.DataFrame([(b, block, short(found[i[~twice[i]]]).tobytes(), short(found[i[twice[i]]]).tobytes()) for b, i in groups], columns=names(ANCHORS))


def add_up(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of rows of one bucket, and which of them several rows, or several documents of one, hold."""
    once, twice = joined(pdf["once"], np.uint32), joined(pdf["twice"], np.uint32)
    found, n = np.unique(np.concatenate([once, twice, twice]), return_counts=True)
    return found, n > 1


def tell(pdf: pd.DataFrame, shared: np.ndarray) -> pd.DataFrame:
    """For each row its anchors of one document that are shared; its block knows those of several."""
    rows = [(block, b, x[member(x, shared)].tobytes()) for block, b, x in zip(pdf["block"], pdf["bucket"], (np.frombuffer(x, np.uint32) for x in pdf["once"]))]
    return pd.DataFrame([r for r in rows if r[2]], columns=names(SHARED))


def window_rows(a, b, doc, many, groups, block: int) -> pd.DataFrame:
    """A row for each bucket: hash halves, whether several documents hold the window, and the smallest of them, by its number among the row's documents."""
    rows = []
    for g, i in groups:
        own, place = np.unique(doc[i], return_inverse=True)
        rows.append((g, block, a[i].tobytes(), b[i].tobytes(), own.tobytes(), place.astype(np.uint16 if len(own) <= 65536 else np.uint32).tobytes(), np.packbits(many[i]).tobytes()))
    return pd.DataFrame(rows, columns=names(WINDOWS))


def read_windows(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Hash halves, documents, several-flags and row numbers of rows of window_rows()."""
    sizes = [len(x) // 8 for x in pdf["first"]]
    doc = [np.frombuffer(d, np.int64)[np.frombuffer(p, np.uint16 if len(p) == 2 * n else np.uint32)] for d, p, n in zip(pdf["docs"], pdf["doc"], sizes)]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["many"], sizes)]
    return joined(pdf["first"], U64), joined(pdf["second"], np.uint32), np.concatenate([np.empty(0, np.int64), *doc]), np.concatenate([np.empty(0, bool), *many]), np.repeat(np.arange(len(pdf)), sizes)


def leasts(a, b, doc, many, in_order: bool = False):
    """The order by window and document, where a new window begins in it, and which windows several documents hold."""
    order = by_hash(a, b, doc, in_order)
    a, b, doc, many = a[order], b[order], doc[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    last = np.concatenate([at[1:], [len(a)]])[: len(at)] - 1
    several = (doc[last] > doc[at]) | (np.logical_or.reduceat(many, at) if len(at) else many[:0])
    return order, at, several


def least_rows(pdf: pd.DataFrame, a, b, least, keep, row) -> pd.DataFrame:
    """A row for each of the rows with windows to keep."""
    order = np.flatnonzero(keep)[np.argsort(row[keep], kind="stable")]
    numbers, at = np.unique(row[order], return_index=True)
    blocks, buckets = pdf["block"].to_numpy(), pdf["bucket"].to_numpy()
    rows = [(blocks[n], buckets[n], a[i].tobytes(), b[i].tobytes(), least[i].tobytes()) for n, i in zip(numbers, np.split(order, at[1:]))]
    return pd.DataFrame(rows, columns=names(LEAST))


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = 6_000_000, bucket_bytes: int = 16_000_000, most_buckets: int = 4096, team: int = 4096) -> DataFrame:
    """doc_id, text (words that stay, joined by one space), n_words, n_removed for each row of docs(doc_id, text).

    A word goes if it lies in a run of `window` words that also starts in a document with a smaller doc_id;
    runs are judged on the texts as they came. A null or empty text has no words. Rows that share a doc_id
    are one document to this rule: neither is smaller. Rows without doc_id come after all others (like the
    largest long) and take nothing from each other. An empty table gives an empty result. Other columns are
    ignored.
    """
    docs = pick(docs, doc_id="doc_id", text="text").select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.col("text").cast("binary").alias("text"))
    _, volume = text_volume(docs)
    n_blocks, buckets = max(12, -(-volume // block_bytes)), max(16, -(-volume // bucket_bytes))
    n_buckets = min(most_buckets, buckets)
    parts = -(-buckets // n_buckets)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).groupBy("block")

    def send_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        found, twice, _, _ = Block(pdf, window, cached_words()).counted()
        return anchor_rows(found, twice, dealt(upper(found, n_buckets), n_buckets), pdf["block"].iloc[0])

    def find_shared(pdf: pd.DataFrame) -> pd.DataFrame:
        found, several = add_up(pdf)
        return tell(pdf, found[several])

    def team_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        found, several = add_up(pdf)
        groups = [(int(pdf["bucket"].iloc[0]) * parts + p, i) for p, i in dealt(lower(found.astype(U64), parts), parts)]
        return anchor_rows(found, several, groups, pdf["team"].iloc[0])

    def team_shared(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names(SHARED))
        found, several = add_up(pdf)
        return tell(pdf, np.union1d(found[several], joined(told["shared"], np.uint32)))

    def send_windows(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names(WINDOWS))
        block = Block(pdf, window, cached_words())
        found, twice, at, anchors = block.counted()
        told = np.sort(np.concatenate([np.empty(0, U64), *[np.frombuffer(x, np.uint32).astype(U64) | U64(b) << U64(32) for b, x in zip(shared["bucket"], shared["shared"])]]))
        hits = found[twice | member(upper(found, n_buckets) << U64(32) | short(found).astype(U64), told)]
        k, a, b = block.windows(hits, at, anchors)
        doc, many = block.ids[k], np.zeros(len(k), bool)
        order, first, several = leasts(a, b, doc, many, True)
        a, b, doc = a[order][first], b[order][first], doc[order][first]
        return window_rows(a, b, doc, several, dealt(upper(a, n_buckets), n_buckets), pdf["block"].iloc[0])

    def find_first(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, doc, many, row = read_windows(pdf)
        order, first, _ = leasts(a, b, doc, many)
        a, b, doc, many, row = a[order], b[order], doc[order], many[order], row[order]
        least = np.repeat(doc[first], np.diff(np.concatenate([first, [len(a)]])))
        return least_rows(pdf, a, b, least, (least < doc) | many, row)

    def team_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, doc, many, _ = read_windows(pdf)
        order, first, several = leasts(a, b, doc, many)
        a, b, doc = a[order][first], b[order][first], doc[order][first]
        groups = [(int(pdf["bucket"].iloc[0]) * parts + p, i) for p, i in dealt(lower(a, parts), parts)]
        return window_rows(a, b, doc, several, groups, pdf["team"].iloc[0])

    def team_first(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(told):
            return pd.DataFrame(columns=names(LEAST))
        a, b, doc, many, row = read_windows(pdf)
        least = Pairs(joined(told["first"], U64), joined(told["second"], np.uint32), joined(told["least"], np.int64)).find(a, b, NO_ID)
        return least_rows(pdf, a, b, least, (least < doc) | ((least == doc) & many), row)

    def drop_words(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "none", "text", "n_words", "n_removed"]
        if not len(pdf):
            return pd.DataFrame(columns=columns)
        block = Block(pdf, window, cached_words())
        gone, lost = None, np.zeros(len(pdf), np.int64)
        if len(told) and len(block.whole):
            pairs = Pairs(joined(told["first"], U64), joined(told["second"], np.uint32), joined(told["least"], np.int64))
            x = window_hashes(block.hashes, window, FIRST, keep=block.whole)
            hit = member(x, pairs.a)
            starts, x = block.whole[hit], x[hit]
            least = pairs.find(x, short(window_hashes(block.hashes, window, SECOND, starts)), NO_ID)
            starts = starts[least < block.ids[block.doc[starts]]]
            edge = np.bincount(starts, minlength=len(block.hashes) + 1) - np.bincount(starts + window, minlength=len(block.hashes) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.bincount(block.doc[gone], minlength=len(pdf))
        rows, at = [], 0
        for i, none, words, n in zip(block.ids, block.none, block.words, lost.tolist()):
            kept = list(compress(words, ~gone[at : at + len(words)])) if n else words
            rows.append((i, none, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), n))
            at += len(words)
        return pd.DataFrame(rows, columns=columns)

    def in_teams(rows: DataFrame) -> DataFrame:
        return rows.withColumn("team", F.expr(f"block div {team}"))

    def replies(rows: DataFrame, schema: str, reply: str, answer, gather, team_answer) -> DataFrame:
        """What buckets tell blocks: at once, or by way of teams and the bucket's parts."""
        if parts == 1:
            return rows.groupBy("bucket").applyInPandas(answer, reply)
        rows = in_teams(rows)
        told = rows.groupBy("bucket", "team").applyInPandas(gather, schema).groupBy("bucket").applyInPandas(answer, reply)
        told = told.select(F.col("block").alias("team"), F.expr(f"bucket div {parts}").alias("bucket"), *[c for c in names(reply) if c not in ("block", "bucket")])
        return rows.groupBy("bucket", "team").cogroup(told.groupBy("bucket", "team")).applyInPandas(team_answer, reply)

    shared = replies(blocks.applyInPandas(send_anchors, ANCHORS), ANCHORS, SHARED, find_shared, team_anchors, team_shared)
    sent = blocks.cogroup(shared.groupBy("block")).applyInPandas(send_windows, WINDOWS)
    first = replies(sent, WINDOWS, LEAST, find_first, team_windows, team_first)
    kept = blocks.cogroup(first.groupBy("block")).applyInPandas(drop_words, "doc_id long, none boolean, text string, n_words long, n_removed long")
    return kept.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text", "n_words", "n_removed")
