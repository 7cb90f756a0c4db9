"""SentencePiece encoding and decoding.

Encoding: spaces become the piece alphabet's space mark, one more goes in front of a text that is not empty, and the
segmentation with the best sum of piece scores wins.  An Aho-Corasick automaton over all pieces reads the text once;
at each place the matches that end there (the automaton's output links) relax the best score of that place, longest
first, and a tie keeps the first.  A character that is no piece by itself may also stand alone: that costs ``unknown_cost`` more than the
worst piece, and it becomes its UTF-8 bytes as byte pieces, or the unknown piece where the vocabulary has no byte pieces.

The text is cut where no piece can cross: before a run of space marks and around control characters that only pieces of
their own hold.  Best scores add up over such cuts, so segments are solved one by one, and a bounded table keeps
the segments seen.

Decoding joins the pieces; space marks become spaces and the one in front goes.  A space mark in the text itself is
written as bytes, so that every text comes back unchanged if the vocabulary has byte pieces.

Null texts have null ids and decode to null; empty texts have no ids.  A very long text is cut like any other, its
pieces are one row.  Repeated rows each get a row; columns stay, and added ones take other names where they clash.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, modest_batches

MARK = "▁"
#: The vocabulary that the registered query takes; any other path goes as well.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TABLE_SIZE = 150_000
#: Rows that are encoded or decoded before they are handed on.
ROWS = 500


@dataclass(frozen=True)
class Vocabulary:
    """pieces: text and score by id; byte_ids: the ids of the 256 byte pieces, if there are; unknown: its id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file, read on the driver; tasks get it with the function they run."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    number = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
    return Vocabulary(pieces, tuple(model.get_score(i) for i in range(n)), tuple(not x for x in odd), tuple(number[b] for b in range(256)) if len(number) == 256 else (), model.unk_id())


class Codec:
    def __init__(self, vocabulary: Vocabulary, unknown_cost: float = 10.0):
        v = vocabulary
        own = [(p, i) for i, p in enumerate(v.pieces) if v.plain[i] and p]
        self.unknown, self.byte_ids = v.unknown, v.byte_ids
        self.miss = min((v.scores[i] for _, i in own if v.scores[i] > -1e8), default=0.0) - unknown_cost
        self.single = {p for p, _ in own if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in own:
            self.automaton.add_word(p, (len(p), v.scores[i], i))
        self.automaton.make_automaton()
        # a control character that no longer piece holds is a segment of its own
        joined = {c for p, _ in own if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(32)) if c not in joined)
        crossing = any(MARK in p.lstrip(MARK) for p, _ in own)
        own_cut = re.escape(alone)
        cut = f"[{own_cut}]|" if alone else ""
        self.segment = re.compile(r"(?s).+" if crossing else f"{cut}{MARK}+[^{MARK}{own_cut}]*|[^{MARK}{own_cut}]+")
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        raw = [bytes([self.byte_of(i)]) if i in set(v.byte_ids) else p.replace(MARK, " ").encode() if v.plain[i] else b"" for i, p in enumerate(v.pieces)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def byte_of(self, piece: int) -> int:
        return self.byte_ids.index(piece)

    def best(self, text: str) -> list[int]:
        """The best segmentation of one segment."""
        n = len(text)
        if self.single.issuperset(text):  # every place is reached by a match: no character stands alone
            score, via = [0.0] + [-np.inf] * n, [None] * (n + 1)
            for end, match in self.automaton.iter(text):
                s = score[end + 1 - match[0]] + match[1]
                if s > score[end + 1]:
                    score[end + 1], via[end + 1] = s, match
            out, at = [], n
            while at:
                length, _, i = via[at]
                out.append(i)
                at -= length
            return out[::-1]
        score, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        matches = self.automaton.iter(text)
        item = next(matches, None)
        for end in range(n):
            to = end + 1
            while item is not None and item[0] == end:
                length, s, i = item[1]
                s += score[to - length]
                if s > score[to]:
                    score[to], back[to] = s, (length, i)
                item = next(matches, None)
            if text[end] not in self.single:
                s = score[end] + self.miss
                if s > score[to]:
                    score[to], back[to] = s, (1, -1)
        out, at = [], n
        while at:
            length, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(self.unknown)
            at -= length
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if MARK in text:
            parts = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    parts.append(np.array([self.byte_ids[b] for b in MARK.encode()] if self.byte_ids else [self.unknown], np.int32).tobytes())
                parts += self.pieces((MARK if k == 0 else "") + part.replace(" ", MARK))
        else:
            parts = self.pieces(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join(parts), np.int32)

    def pieces(self, text: str) -> list[bytes]:
        out, table = [], self.table
        for s in self.segment.findall(text):
            ids = table.get(s)
            if ids is None:
                ids = self.older.get(s) or array("i", self.best(s)).tobytes()
                if len(s) < 64:
                    if len(table) >= TABLE_SIZE:  # what was used since the last turn stays for one more
                        self.older, self.table = table, {}
                        table = self.table
                    table[s] = ids
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.length[ids]
        total = np.cumsum(n)
        at = np.arange(int(total[-1])) - np.repeat(total - n, n) + np.repeat(self.begin[ids], n)
        out = self.bytes[at].tobytes()
        return out[1:] if out[:1] == b" " else out


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int)."""
    modest_batches(docs.sparkSession)
    (ids_col,) = fresh(docs, "piece_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in sliced(batches):
            ids = [None if t is None else codec.encode(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(ids)], names=[*batch.schema.names, ids_col])

    return docs.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)
        give_back()


def lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *[0 if r is None else len(r) for r in rows]]).astype(np.int32)
    own = [r for r in rows if r is not None]
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.empty(0, np.int32), pa.int32()), mask=mask)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``decoded`` (string).  Ids outside the vocabulary raise an error; null in a list is skipped."""
    modest_batches(encoded.sparkSession)
    (text_col,) = fresh(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in sliced(batches):
            texts = [None if not x.is_valid else codec.decode(x.values.drop_null().to_numpy()).decode("utf-8", "replace") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(run, schema)


def query(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces among them), ids_sha256 (ids, comma-joined), round_trip."""
    v = load(model)
    out = decode(encode(docs.select("doc_id", "text"), v), v)
    low, high = (min(v.byte_ids), max(v.byte_ids)) if v.byte_ids else (0, -1)
    return out.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.coalesce(F.size(F.filter("piece_ids", lambda x: x.between(low, high))), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.concat_ws(",", F.coalesce("piece_ids", F.array().cast("array<int>")).cast("array<string>")), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
