"""Token counts of whole texts, huge ones in overlapping chunks.

A text of up to ``chunk`` characters is encoded at once.  A longer one is cut
into chunks that overlap, spread over the cluster and encoded with offsets; the
counts are spliced where both neighbours agree.

Why a splice is exact: the tokenizer first matches its word pattern from left to
right without looking back, and encodes each match by itself, so what follows a
match's start depends on the text from there on alone.  Take a position p at
which both chunks begin a match.  In the left chunk, p and the match after it
end well before the chunk does (MARGIN characters, more than any look-ahead or
special string), so the chunk's end has not moved them and p begins a match of
the whole text too.  From p on the right chunk then goes on as the whole text
does.  Where no such position lies in an overlap (a run without word ends), the
overlaps are widened fourfold and that text is encoded again; an overlap as
long as the text is the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import others, unused
from .storage import Scratch, importable_in_workers

CHUNK = 32_768
OVERLAP = 512
MARGIN = 32
LIMIT = 512
# Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(spec: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_buffer(spec)
    out.no_truncation()
    out.no_padding()
    return out


#: Letters, digits and marks on which the two engines' word patterns are known to agree.
_COMMON = re.compile("[\t-\r -~\xa1-\u024f]*")


@lru_cache(maxsize=2)
def _counter(spec: bytes):
    """The same tokenizer in an engine without offsets, several times as fast."""
    import json

    import tiktoken

    model = json.loads(spec)
    byte_of = _byte_alphabet()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items()
             if all(c in byte_of for c in piece)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    return tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def count_tokens(spec: bytes, texts: list[str]) -> list[int]:
    """Tokens of each text; texts with rarer characters go through the tokenizers library itself."""
    tok, fast = _tokenizer(spec), _counter(spec)
    return [len(fast.encode(t, allowed_special="all")) if _COMMON.fullmatch(t)
            else len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def chunk_spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; each shares ``overlap`` characters with the next."""
    step = max(chunk, 2 * overlap)
    return [(at, min(length, at + step + overlap))
            for at in range(0, max(1, length - overlap), step)]


def encode_chunk(tok, text: str, start: int, first: bool, last: bool, overlap: int) -> dict:
    """Tokens of a chunk, and the word starts (position, tokens before) in its two overlaps."""
    code = tok.encode(text, add_special_tokens=False)
    words = np.array(code.word_ids, np.int64)
    begins = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, int)
    offsets = code.offsets
    at = np.array([offsets[i][0] for i in begins], np.int64)
    head = np.zeros(len(at), bool) if first else at < overlap
    tail = np.zeros(len(at), bool)
    if not last and len(at) > 1:
        # A word counts if the next one begins before the margin too.
        tail[:-1] = (at[:-1] >= len(text) - overlap) & (at[1:] <= len(text) - MARGIN)
    return {"n": len(words), "head_at": (start + at[head]).tolist(), "head_n": begins[head].tolist(),
            "tail_at": (start + at[tail]).tolist(), "tail_n": begins[tail].tolist()}


def splice(parts: list[dict]) -> int | None:
    """Tokens of the whole text from its chunks' encodings in order; None if two don't align."""
    total, begin = 0, 0
    for left, right in zip(parts, parts[1:], strict=False):
        right_n = dict(zip(right["head_at"], right["head_n"], strict=True))
        for at, n in zip(left["tail_at"], left["tail_n"], strict=True):
            if at in right_n:
                total += n - begin
                begin = right_n[at]
                break
        else:
            return None
    return total + parts[-1]["n"] - begin


_PART = "n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row of ``docs`` with n_bytes (UTF-8) and n_tokens of its whole text.

    The counts are those of the tokenizers library for the file, without
    added special tokens; a null text is empty: 0 and 0.  The two columns
    replace columns of the same names, in upper or lower case; repeated rows
    are counted alike; no rows give no rows.
    ``tokenizer_path`` is read on the driver and sent to the workers.
    """
    spark = docs.sparkSession
    importable_in_workers(spark)
    with open(tokenizer_path, "rb") as file:
        spec = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(spec.value, [t or "" for t in texts]), dtype="int64")

    kept = [F.col(f"`{c}`") for c in others(docs.columns, ("n_bytes", "n_tokens"))]
    row = unused(docs.columns, "_row")[0]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"))
    long = F.length(text) > chunk
    short = sized.where(~long).withColumn("n_tokens", count(F.col(text_col)))

    scratch = Scratch(spark, "tokens")
    huge = scratch.table(docs.where(long).select(*kept).withColumn(
        row, F.monotonically_increasing_id()), "huge")
    counted = None
    texts = huge.select(F.col(row).alias("_row"), F.col(text_col).alias("text"))
    todo = texts
    while not todo.isEmpty():
        done = scratch.table(_in_chunks(todo, spec, chunk, overlap), "spliced")
        counted = done if counted is None else counted.unionAll(done)
        overlap *= 4
        todo = texts.join(
            counted.where("n_tokens IS NOT NULL"), "_row", "left_anti")
    if counted is None:
        scratch.keep()
        return short
    found = counted.where("n_tokens IS NOT NULL").withColumnRenamed("_row", row)
    return short.unionByName(huge.join(found, row).withColumn(
        "n_bytes", F.octet_length(text).cast("long")).drop(row).select(*(F.col(f"`{c}`") for c in short.columns)))


def _in_chunks(texts: DataFrame, spec, chunk: int, overlap: int) -> DataFrame:
    """(_row, n_tokens) of each text; n_tokens is null where chunks don't align."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["_row"], batch["text"], strict=True):
                spans = chunk_spans(len(text), chunk, overlap)
                for at in range(0, len(spans), 64):
                    own = spans[at: at + 64]
                    yield pd.DataFrame({
                        "_row": row, "part": range(at, at + len(own)), "start": [a for a, _ in own],
                        "last": [b == len(text) for _, b in own], "text": [text[a:b] for a, b in own]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(spec.value)
        for batch in batches:
            rows = [{"_row": r["_row"], "part": r["part"]} | encode_chunk(
                tok, r["text"], r["start"], r["start"] == 0, r["last"], overlap)
                for r in batch.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        n = splice(rows.sort_values("part").to_dict("records"))
        return pd.DataFrame({"_row": rows["_row"].iloc[:1], "n_tokens": pd.array([n], "Int64")})

    parts = texts.mapInPandas(cut, "_row long, part int, start long, last boolean, text string")
    return (parts.repartition("_row", "part").mapInPandas(encode, f"_row long, part int, {_PART}")
            .groupBy("_row").applyInPandas(join, "_row long, n_tokens long"))
