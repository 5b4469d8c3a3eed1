"""SentencePiece encoding and decoding of whole texts.

The pieces of a model form an Aho-Corasick automaton.  One pass over a text
visits every piece that ends at each position (the automaton's output links)
and relaxes the best score there: the Viterbi path of a unigram model.  A
character that no piece holds costs the model's unknown score and is written as
byte pieces where the model has them.

No piece runs past the end of a word into the next word mark, so a text falls
into stretches that are segmented apart without changing the best path; a
bounded store keeps the stretches that come again.  A stretch may be as long as
the text: its path is kept as two flat arrays.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import others, unused
from .storage import importable_in_workers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Most stretches that a worker remembers, and their most characters.
STORE, STORE_CHARS = 300_000, 64


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at: at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at: at + size]
            at += size


class Pieces:
    """A model file's pieces with their automaton; encodes and decodes strings."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, self.squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                normalizer = dict(_fields(value))
                if normalizer.get(2):
                    raise ValueError("models with a character map are not supported")
                self.dummy_prefix = bool(normalizer.get(3, 1))
                self.squeeze = bool(normalizer.get(4, 1))
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in
                         enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        usable = [(i, p) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
                  if k in (NORMAL, USER_DEFINED)]
        self.known = {p for _, p in usable if len(p) == 1}
        self.automaton = self._automaton(usable)
        # A piece that its best split beats is on no best path.
        self.automaton = self._automaton(
            [(i, p) for i, p in usable if len(p) == 1 or self.viterbi(p) == [i]])
        joined = {c for _, p in usable if len(p) > 1 for c in p}
        across = any(MARK in p.lstrip(MARK) for _, p in usable)
        # Characters in no longer piece stand alone; else a stretch is a run of marks and a word.
        self.stretches = None if across else re.compile(
            f"{MARK}*[^{MARK}]+|{MARK}+")
        self.alone = re.compile("([^" + re.escape("".join(sorted(joined))) + "])") if joined else None
        self.store: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # What an id alone decodes to; None where that depends on its neighbours.
        self.plain = [p.replace(MARK, " ") if k in (NORMAL, USER_DEFINED, UNUSED) else
                      chr(int(p[3:5], 16)) if k == BYTE and int(p[3:5], 16) < 128 else
                      " ⁇ " if k == UNKNOWN else "" if k == CONTROL else None
                      for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _automaton(self, usable: list[tuple[int, str]]):
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, piece in usable:
            out.add_word(piece, (len(piece), i, self.scores[i]))
        out.make_automaton()
        return out

    def normalize(self, text: str) -> str:
        """The text with word marks for spaces, as the model's normalizer gives it."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over one stretch of normalized text; the longer piece wins a tie."""
        n = len(text)
        best, sizes, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
        done = n if self.known.issuperset(text) else 0

        def unknowns(upto: int) -> None:
            """Relax the characters before ``upto`` that are no pieces, in their turn."""
            nonlocal done
            while done < upto:
                done += 1
                total = best[done - 1] + self.unknown_score
                if text[done - 1] not in self.known and total > best[done]:
                    best[done], sizes[done], pieces[done] = total, 1, -1

        for last, (size, piece, score) in self.automaton.iter(text):
            if done < last:
                unknowns(last)
            end = last + 1
            total = best[end - size] + score
            if total > best[end]:
                best[end], sizes[end], pieces[end] = total, size, piece
        unknowns(n)
        out: list[int] = []
        at = n
        while at:
            piece = pieces[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                data = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(data)]
            else:
                out.append(self.unknown_id)
            at -= sizes[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of a whole text; none for a null or empty one."""
        text = self.normalize(text or "")
        if self.stretches is None:
            return self.viterbi(text)
        out: list[int] = []
        store = self.store
        for stretch in self.stretches.findall(text):
            ids = store.get(stretch)
            if ids is None:
                ids = self.older.get(stretch)
                if ids is None:
                    ids = []
                    for part in self.alone.split(stretch) if self.alone else [stretch]:
                        if part:
                            ids += self.viterbi(part)
                if len(stretch) <= STORE_CHARS:
                    if len(store) >= STORE // 2:
                        self.older, self.store = store, {}
                        store = self.store
                    store[stretch] = ids = tuple(ids)
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of piece ids; byte pieces join to characters, other bytes become U+FFFD."""
        parts = [self.plain[i] for i in ids]
        if None in parts:
            parts, held = [], bytearray()
            for i in ids:
                if self.kinds[i] == BYTE:
                    held.append(int(self.pieces[i][3:5], 16))
                    continue
                if held:
                    parts.append(held.decode("utf-8", "cspulse-each-byte"))
                    held.clear()
                parts.append(self.plain[i])
            parts.append(held.decode("utf-8", "cspulse-each-byte"))
        text = "".join(parts)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """U+FFFD for every byte that is no part of a character."""
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("cspulse-each-byte", _each_byte)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


#: Characters that a worker turns into ids before it hands rows on.
SLICE_CHARS = 1 << 19


def _ids_array(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1])))


def _length(column: pa.Array) -> pa.Array:
    return pc.list_value_length(column) if pa.types.is_list(column.type) else pc.utf8_length(column)


def _slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for at, size in enumerate(sizes):
        held += size
        if held >= SLICE_CHARS or at + 1 == len(sizes):
            yield batch.slice(start, at + 1 - start)
            start, held = at + 1, 0


def _rows(rows: DataFrame, model_path: str, source: str, made: list[tuple[str, str]], make) -> DataFrame:
    """``rows`` with the columns ``made`` (name, type), which replace columns of the same names.

    ``make(pieces, values of source)`` gives the new columns' arrays of a slice.
    """
    spark = rows.sparkSession
    importable_in_workers(spark)
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    names = [name for name, _ in made]
    kept = others(rows.columns, names)
    rows = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`").alias(unused(rows.columns, "_source")[0]))
    schema = rows.select(*(F.col(f"`{c}`") for c in kept),
                         *(F.lit(None).cast(kind).alias(name) for name, kind in made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model.value)
        for batch in batches:
            last = batch.num_columns - 1
            sizes = pc.coalesce(_length(batch.column(last)), 0).to_pylist()
            for part in _slices(batch, sizes):
                new = make(own, part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *new],
                                                 names=[*part.schema.names[:last], *names])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``ids``: the piece ids of its whole text, null or empty: [].

    ``ids`` replaces a column of that name, in upper or lower case; repeated
    rows are encoded alike.  No rows give no rows.
    """
    return _rows(docs, model_path, text_col, [("ids", "array<int>")],
                 lambda own, texts: [_ids_array([own.encode(t) for t in texts])])


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Every row with ``decoded``: the text of its piece ids; null ids give null."""
    return _rows(rows, model_path, ids_col, [("decoded", "string")], lambda own, ids: [
        pa.array([None if x is None else own.decode(x) for x in ids], pa.string())])


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``ids``, ``decoded`` and ``round_trip``.

    ``round_trip`` tells whether the decoded text is the text (null: empty).
    Null and empty texts have no ids and decode to the empty text; repeated rows
    are encoded alike; the three columns replace columns of their names, in
    upper or lower case.  No rows give no rows.
    """
    def make(own: Pieces, texts: list[str | None]) -> list[pa.Array]:
        ids = [own.encode(t) for t in texts]
        decoded = [own.decode(x) for x in ids]
        return [_ids_array(ids), pa.array(decoded, pa.string()),
                pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)], pa.bool_())]

    return _rows(docs, model_path, text_col,
                 [("ids", "array<int>"), ("decoded", "string"), ("round_trip", "boolean")], make)
