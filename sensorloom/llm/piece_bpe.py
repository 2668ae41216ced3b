"""SentencePiece BPE by a merge-type prefix table.

The byte-pair encoding of any prefix of a chunk ends in one certain token. The table holds that token for
every prefix: an automaton reports the vocabulary's pieces that end at a position, and the one that belongs
there is the longest whose start's last token may stand before it. Two tokens may stand side by side if
encoding their joint text gives back the two. The ids are then read from the end backwards, each token's
length leading to the prefix before it. One pass over the characters, no merge queue.

Runs of the space mark need a rule of their own: their pieces share one score, lower than all others, so
they merge last and from the left, into pieces as long as the vocabulary has. A text is split where no piece
spans the two characters, which changes nothing, and each chunk's ids are remembered for a bounded number of
chunks. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

MARK = "▁"  # stands for a space (fixed value)
NORMAL, CONTROL, BYTE = 1, 3, 6  # kinds of pieces (fixed values of the file format)


class PieceTable:
    """A SentencePiece BPE model with byte fallback, a leading space mark and no other normalisation."""

    def __init__(self, model: bytes, most: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.piece_id, self.score, self.byte_id = {}, {}, {}
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.lead, self.tail = np.array([[self.begin], [self.end]], "<u4")
        self.lead, self.tail = self.lead.tobytes(), self.tail.tobytes()
        self.raw: list[bytes] = []
        for k, p in enumerate(proto.pieces):
            self.raw.append(p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"")
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = k
                self.raw[k] = bytes([int(p.piece[3:5], 16)])
            elif p.type == NORMAL:
                self.piece_id[p.piece], self.score[p.piece] = k, p.score
            elif p.type not in (CONTROL, 2):
                raise ValueError(f"piece {p.piece!r} has kind {p.type}, which is not supported")
        marks = sorted(len(p) for p in self.piece_id if not p.strip(MARK))
        self.spines: dict[str, tuple | None] = {}
        self.longest_run = most_marks = marks[-1]
        self.rests = [self.merged(MARK * k) for k in range(most_marks)]
        last = max((self.score[MARK * k] for k in marks if k > 1), default=0.0)
        if (
            any(MARK in p[1:] and p.strip(MARK) for p in self.piece_id)
            or any(len(p) > 1 and p.strip(MARK) and s <= last for p, s in self.score.items())
            or any(self.merged(MARK * (2 * most_marks + k)) != [MARK * most_marks] * 2 + r for k, r in enumerate(self.rests))
        ):
            raise ValueError("space marks may only lead a piece, and runs of them must merge last and from the left")
        self.automaton = ahocorasick.Automaton()
        for p in self.piece_id:
            if len(p) > 1:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        #: Chunks: marks with what follows them; where no piece mixes letters with others, letters and others apart.
        others = "".join(sorted({c for p in self.piece_id for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = re.compile(rf"[^\W\d_{others}]")
        mixes = any(bool(letter.match(a)) != bool(letter.match(b)) for p in self.piece_id for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]))
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if mixes else rf"{MARK}*[^\W\d_{others}]+|{MARK}*(?:(?!{MARK})[\W\d_{others}])+|{MARK}+")
        self.known = Chunks(self, most)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs, self.most = 0, most

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The merges themselves, one after the other: for single pieces and short texts. steps: gets each merge's two parts, and where the left one starts."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            if steps is not None:
                steps.append((parts[k], parts[k + 1], sum(map(len, parts[:k]))))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def edges(self, piece: str) -> tuple | None:
        """How the piece grows at its left and at its right edge: what stands there, and the score of the merge that takes it in.

        None if its text does not encode as the piece, or a merge has a higher score than one that it waits for.
        """
        if piece not in self.spines:
            steps: list = []
            left, right, good = [(piece[0], None)], [(piece[-1], None)], self.merged(piece, steps) in ([piece], list(piece))
            low = float("inf")
            for a, b, at in steps:
                got = self.score[a + b]
                good, low = good and got <= low, min(low, got)
                if at == 0:
                    left[-1] = (left[-1][0], got)
                    left.append((a + b, None))
                if at + len(a) + len(b) == len(piece):
                    right[-1] = (right[-1][0], got)
                    right.append((a + b, None))
            self.spines[piece] = (left, right) if good else None
        return self.spines[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the joint text of two tokens encodes as the two: no merge across the seam comes before those at its sides."""
        if not left:
            return self.edges(right) is not None or self.merged(right) == [right]
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        i, j, ends, starts, score = 0, 0, a[1], b[0], self.score
        while True:
            (x, x_next), (y, y_next) = ends[i], starts[j]
            across = score.get(x + y)
            if across is not None and (x_next is None or across > x_next) and (y_next is None or across >= y_next):
                return False
            if x_next is None and y_next is None:
                return True
            if y_next is None or x_next is not None and x_next >= y_next:
                i += 1
            else:
                j += 1

    def tokens(self, chunk: str) -> list[str]:
        """The tokens of a chunk that has a mark only at its start, if anywhere."""
        n = len(chunk)
        last = [""] * (n + 1)
        ends: list[list[int]] = [[] for _ in range(n)]
        for at, size in self.automaton.iter(chunk):
            ends[at].append(size)
        if self.n_pairs > self.most:
            self.pairs, self.n_pairs = {}, 0
        pairs = self.pairs
        for k in range(1, n + 1):
            for size in ends[k - 1]:  # the longest comes first
                piece, before = chunk[k - size : k], last[k - size]
                known = pairs.get(before)
                if known is None:
                    known = pairs[before] = {}
                may = known.get(piece)
                if may is None:
                    may = known[piece] = self.may_follow(before, piece)
                    self.n_pairs += 1
                if may:
                    last[k] = piece
                    break
            else:
                last[k] = chunk[k - 1]
        out, k = [], n
        while k:
            out.append(last[k])
            k -= len(last[k])
        return out[::-1]

    def ids_of(self, chunk: str) -> list[int]:
        """The ids of any chunk: of its leading marks, then of the rest."""
        word = chunk.lstrip(MARK)
        run = len(chunk) - len(word)
        tokens: list[str] = []
        if word:
            tokens = self.tokens(MARK + word if run else word)
            run -= run > 0 and tokens[0] != MARK
            tokens = tokens[1:] if tokens[0] == MARK else tokens
        full, rest = divmod(run, self.longest_run)
        ids: list[int] = []
        for t in [MARK * self.longest_run] * full + self.rests[rest] + tokens:
            k = self.piece_id.get(t)
            ids.extend([k] if k is not None else [self.byte_id[b] for b in t.encode("utf-8", "surrogatepass")])
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text with the begin and the end id, as little-endian unsigned 32-bit integers."""
        chunks = self.chunks.findall(MARK + text.replace(" ", MARK)) if text else []
        return b"".join((self.lead, *map(self.known.__getitem__, chunks), self.tail))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces' texts and bytes joined; the mark that encoding put first goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Chunks(dict):
    """The packed ids of chunks that came before, for a bounded number of short chunks."""

    def __init__(self, table: PieceTable, most: int):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.table.ids_of(chunk), "<u4").tobytes()
        if len(chunk) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


_TABLES: dict[int, PieceTable] = {}


def table_of(model: bytes) -> PieceTable:
    """One table a worker and model."""
    key = hash(model)
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def packed(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, packed (ids as little-endian unsigned 32-bit integers) and decoded text for each row of docs(doc_id, text).

    The model file (half a MB, of fixed size) is read once on the driver and travels with the tasks. One Python
    stage does it all: a second one would double the workers, and each may come to hold a table and its caches.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    table_of(model)  # fails here, not in a task, if the model is of another kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = table_of(model)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                ids = [table.encode_bytes(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "packed": ids, "decoded": [table.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]})

    rows = pick(small_batches(docs), doc_id="doc_id", text="text").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))  # pandas would round ids beside nulls
    return rows.mapInPandas(run, "doc_id string, packed binary, decoded string").withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int, with begin and end id) and decoded text for each row of docs(doc_id, text).

    The ids equal those of the library. A null text is encoded like an empty one: begin and end id alone,
    decoded to an empty text. Repeated rows give repeated rows; no row is dropped; other columns are ignored.
    """
    digits = F.hex("packed")
    # Eight hexadecimal digits an id, bytes from the lowest up.
    at = lambda k, b: F.substring(digits, (8 * k + 2 * b + 1).cast("int"), F.lit(2))
    n = (F.octet_length("packed") / 4).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(F.concat(at(k, 3), at(k, 2), at(k, 1), at(k, 0)), 16, 10).cast("int"))
    return packed(docs, model_path).select("doc_id", ids.alias("ids"), "decoded")


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 of a row of packed()."""
    return [(F.octet_length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the packed ids and of the decoded text in UTF-8."""
    return packed(docs, model_path).select("doc_id", *digest_columns())


def with_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, packed, decoded of packed() with the digests beside them."""
    return packed(docs, model_path).select("doc_id", "packed", "decoded", *digest_columns())
