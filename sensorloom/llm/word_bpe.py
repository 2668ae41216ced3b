"""Byte-pair encoding with word ends by tree concatenation.

A text is normalised and cut into words by the model's pattern. A word of at most LEAF symbols is merged
outright. A longer one is a tree: its halves are encoded on their own, and their join is mended by encoding a window
around it again, of one token on either side, then two, four and so on, until the window's first and last tokens are
those that stood there. That is exact: a sequence of tokens is the encoding of its text if and only if every two
neighbours are the encoding of theirs, and every neighbouring pair of the result stands in a half's encoding or in
the window's.

Runs of RUN characters and more without white space do not stay in one task: such texts are normalised once, their long
words are cut into pieces which are dealt over the cluster and encoded in parallel, and the pieces of a
word are joined as a tree when its text is put together. Equal texts of that kind are encoded once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Symbols of a word that are merged outright, and of a piece that is dealt out.
LEAF, PIECE = 64, 16_384
#: Characters without white space from which a text is cut up and dealt over tasks.
RUN = 65_536

IDS, NEVER = (1 << 20) - 1, 1 << 60

# Fixed values of the supported file: its normaliser, pattern and word end.
NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# White space of the pattern.
BLANK = r"\x09-\x0d\x20\x85\xa0  -     　"
# Letters (without capitals) and numbers below U+0250, for which the faster of the two pattern libraries will do.
LATIN, LATIN_NUMBERS = r"a-zªµºß-öø-\u024f", r"0-9²³¹¼-¾"
#: Characters which Python and the library class and lower alike; texts with any other go through the library's own normaliser and pattern.
COMMON = r"[\x00-՗Ḁ-῿ -⁠　-鿿가-힣]*+"


class MergeTable:
    """The merges of a file of the tokenizers library whose kind is that of word_bpe_49k.json."""

    def __init__(self, text: str, most: int = 200_000):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model, norm, cut = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [(n["type"], n.get("pattern", {}).get("Regex")) for n in norm.get("normalizers", [])]
        split, level = [*cut.get("pretokenizers", []), {}, {}][:2]
        known = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["continuing_subword_prefix"] and not model["dropout"] and not model["byte_fallback"]
        known = known and kinds == NORMALIZER and split.get("pattern") == {"Regex": PATTERN} and split["invert"] and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
        known = known and spec["decoder"] is None and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not known:
            raise ValueError("only BPE with word ends, its own pattern and no decoder is supported")
        vocab = model["vocab"]
        library = Tokenizer.from_str(text)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The rank of a merge and the token that it makes, in one number.
        self.rank = {(vocab[a], vocab[b]): k * (IDS + 1) + vocab[a + b] for k, (a, b) in enumerate(merges)}
        # Printable bytes stand for themselves, the others for the code points from 256 up.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.inner = [vocab[shown[b]] for b in range(256)]
        self.final = [vocab[shown[b] + WORD_END] for b in range(256)]
        parts = {i: (i,) for i in self.inner + self.final}
        for a, b in merges:
            parts[vocab[a + b]] = parts[vocab[a]] + parts[vocab[b]]
        self.parts = parts
        self.words = Words(self, most)
        self.cut, self.common = regex.compile(PATTERN.replace(r"\s", BLANK)), regex.compile(COMMON)
        simple = PATTERN.replace(r"[\p{L}]", f"[{LATIN}]").replace(r"[\p{N}]", f"[{LATIN_NUMBERS}]").replace(r"\s\p{L}\p{N}", BLANK + LATIN + LATIN_NUMBERS)
        self.cut_latin, self.latin = re.compile(simple), re.compile("[\x00-\u024f]*")

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        out = list(map(self.inner.__getitem__, raw))
        out[-1] = self.final[raw[-1]]
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges by rank, the leftmost first."""
        return self.merged_few(symbols) if len(symbols) <= LEAF else self.merged_many(symbols)

    def merged_few(self, symbols: list[int]) -> list[int]:
        """By the least rank of all neighbours, found anew for each merge."""
        ids, rank = list(symbols), self.rank.get
        found = [rank(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while found:
            least = min(found)
            if least == NEVER:
                break
            k = found.index(least)
            ids[k : k + 2] = [least & IDS]
            del found[k]
            if k < len(found):
                found[k] = rank((ids[k], ids[k + 1]), NEVER)
            if k:
                found[k - 1] = rank((ids[k - 1], ids[k]), NEVER)
        return ids

    def merged_many(self, symbols: list[int]) -> list[int]:
        """By a heap of neighbours, whose stale entries are skipped."""
        ids, n, rank = list(symbols), len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank(p, NEVER), k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            least, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = least & IDS, -1
            after[k] = after[r]
            if after[r] < n:
                before[after[r]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n:
                    p = (ids[at], ids[after[at]])
                    if p in self.rank:
                        heapq.heappush(heap, (self.rank[p], at, *p))
        return [i for i in ids if i >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded texts put together."""
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            got = self.merged([s for t in (*left[a:], *right[:b]) for s in self.parts[t]])
            if (a == 0 or got[0] == left[a]) and (b == len(right) or got[-1] == right[b - 1]):
                return left[:a] + got + right[b:]
            size *= 2

    def encoded(self, symbols: list[int]) -> list[int]:
        """The tokens of the symbols of one word, or of a stretch of one."""
        level = [self.merged(symbols[k : k + LEAF]) for k in range(0, len(symbols), LEAF)]
        return self.all_joined(level)

    def all_joined(self, level: list[list[int]]) -> list[int]:
        """The encodings of the stretches of a word put together as a tree."""
        while len(level) > 1:
            pairs = [self.joined(*level[k : k + 2]) for k in range(0, len(level) - 1, 2)]
            level = pairs + level[2 * len(pairs) :]
        return level[0] if level else []

    def cut_words(self, text: str) -> Iterator[str | int]:
        """The words of a text, and the ids of special tokens that stand in it."""
        pieces = self.marks.split(text) if self.marks else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield self.special[piece]
            elif self.latin.fullmatch(piece) or self.common.fullmatch(piece):
                piece = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
                # Python lowers a sigma by its place in the word, the library does not.
                piece = piece.replace("Σ", "σ").lower()
                yield from (self.cut_latin if self.latin.fullmatch(piece) else self.cut).findall(piece)
            else:
                piece = self.normalizer.normalize_str(piece)
                yield from (piece[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(piece))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.cut_words(text))), "<i4")

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own, a file's tokens are joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


class Words(dict):
    """The packed ids of words that came before, for a bounded number of short words; special tokens are their own id."""

    def __init__(self, table: MergeTable, most: int):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, word: str | int) -> bytes:
        ids = [word] if isinstance(word, int) else self.table.encoded(self.table.symbols(word))
        out = np.array(ids, "<i4").tobytes()
        if isinstance(word, int) or len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


_TABLES: dict[int, MergeTable] = {}


def table_of(spec: str) -> MergeTable:
    """One table a worker and file."""
    key = hash(spec)
    if key not in _TABLES:
        _TABLES[key] = MergeTable(spec)
    return _TABLES[key]


def lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Ids and decoded texts are several times as large as texts: output batches are kept small."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def cut_up(table: MergeTable, text: str, piece: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(seq, word, values) of a text: word 0 has the ids of words in a row, others the symbols of a piece of one long word."""
    seq = word = 0
    ready: list[bytes] = []
    for w in table.cut_words(text):
        symbols = table.symbols(w) if not isinstance(w, int) and len(w) > piece // 4 else []
        if len(symbols) <= piece:
            ready.append(table.words[w])
            continue
        yield seq, 0, np.frombuffer(b"".join(ready), "<i4")
        ready, word = [], word + 1
        for k in range(0, len(symbols), piece):
            seq += 1
            yield seq, word, np.array(symbols[k : k + piece], "<i4")
        seq += 1
    yield seq, 0, np.frombuffer(b"".join(ready), "<i4")


def encode_decode(docs: DataFrame, model_path: str, run: int = RUN, piece: int = PIECE) -> DataFrame:
    """doc_id, ids (array of int) and decoded text for each row of docs(doc_id, text).

    The ids equal those of the library without special tokens added; special tokens that stand in a text keep
    their ids. A null text is encoded like an empty one: no ids, decoded to an empty text. Repeated rows give
    repeated rows; no row is dropped, no text cut off; other columns are ignored. The file (a few MB, of fixed size)
    is read once on the driver and travels with the tasks. run, piece: see RUN and PIECE; results do not depend on them.
    """
    with open(model_path, encoding="utf-8") as f:
        spec = f.read()
    table_of(spec)  # fails here, not in a task, if the file is of another kind
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(shared.value)
        for batch in slices(batches):
            ids = [table.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids), pa.array([table.decode(i.tolist()) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(shared.value)
        for batch in slices(batches, 1):
            (key,) = batch.column("key").to_pylist()
            for seq, word, values in cut_up(table, batch.column("text")[0].as_py(), piece):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seq], pa.int32()), pa.array([word], pa.int32()), lists([values])], ["key", "seq", "word", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(shared.value)
        for batch in slices(batches, 16):
            of = zip(batch.column("word").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            ids = [np.array(table.encoded(v) if word else v, np.int32) for word, v in of]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), batch.column("word"), lists(ids)], ["key", "seq", "word", "ids"])

    def together(rows: pa.Table) -> pa.Table:
        table, ids, level, last = table_of(shared.value), [], [], 0
        rows = rows.sort_by("seq")
        for word, v in zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True):
            if word != last:
                ids, level = ids + table.all_joined(level), []
            last = word
            if word:
                level.append(v)
            else:
                ids.extend(v)
        ids += table.all_joined(level)
        return pa.table({"key": rows.column("key")[:1], "ids": lists([np.array(ids, np.int32)]), "decoded": pa.array([table.decode(ids)])})

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Only texts that are long enough are looked at for runs.
    unsplit = F.when(F.octet_length("text") >= run, F.exists(F.split("text", r"[\x09-\x0D\x20]+"), lambda w: F.char_length(w) >= run)).otherwise(False)
    out = rows.where(~unsplit).mapInArrow(direct, "doc_id long, ids array<int>, decoded string")

    far = rows.where(unsplit).withColumn("key", F.sha2(F.col("text"), 256))
    pieces = far.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(cut, "key string, seq int, word int, ids array<int>")
    whole = pieces.repartition("key", "seq").mapInArrow(encode, "key string, seq int, word int, ids array<int>").groupBy("key").applyInArrow(together, "key string, ids array<int>, decoded string")
    return out.unionByName(far.select("doc_id", "key").join(whole, "key").select("doc_id", "ids", "decoded"))
