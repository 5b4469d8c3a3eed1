"""SimHash near-duplicate detection by anchor points.

A document's 64-bit fingerprint sets each bit that more than half of its
shingle hashes set.  Fingerprints link when at most four bits differ.

Links are found with covering codes.  The 64 bits are cut into six segments, and
six triples of them are laid so that, however four differing bits fall on the
segments, some triple holds at most one of them (threshold d = 1 there).  The 31
to 33 bits of a triple have a code: twice 15 bits take the codewords of the
perfect Hamming code, covering radius R = 1 each, the others every value (R = 0).
The codewords are the anchors, 2^23 to 2^25 a triple.  A fingerprint is
replicated to every anchor within R + d of it (block by block: an excess of at
most d over the blocks' radii), about 16 a triple: if x's nearest anchor is
within R, any y within d of x is within R + d of that anchor, so they meet.
One code over all 64 bits would have to bridge d = 4 at once, which needs over
a thousand copies of each fingerprint for anchors as selective as these.  With
10^9 distinct fingerprints spread evenly an anchor holds 500 to 2,000 of them,
and with 10^10 at most about ANCHOR_ROWS.

Equal fingerprints are one class before the replication, and each anchor gives
a spanning forest of the links it sees, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch, importable_in_workers

SEED = 42
MAX_BITS = 4
# (lowest bit, number of bits) of the segments, and the triples of them that have a code.
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
HAMMING_BITS = 15
#: Most rows of an anchor that one task compares; anchors beyond it are cut into blocks (split_anchors).
ANCHOR_ROWS = 20_000
_SMALL = 512


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(),
                                                       ends[shingle - 1:].tolist(), strict=True)),
            np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _hamming_syndromes() -> np.ndarray:
    """Syndrome of each value of HAMMING_BITS bits: the exclusive or of its set positions, from 1."""
    values = np.arange(1 << HAMMING_BITS)
    out = np.zeros(len(values), np.int64)
    for bit in range(HAMMING_BITS):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


_SYNDROMES = _hamming_syndromes()
# For each syndrome s the masks that lead to codewords: the nearest, then those at distance 2.
_NEAREST = np.array([0] + [1 << (s - 1) for s in range(1, HAMMING_BITS + 1)])
_SECOND = [[]] + [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, HAMMING_BITS + 1)
                   if i < (i ^ s)] for s in range(1, HAMMING_BITS + 1)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, row of ``fps``) for every anchor that each fingerprint is replicated to."""
    keys, rows = [], []
    every = np.arange(len(fps))
    block = (1 << HAMMING_BITS) - 1
    for number, triple in enumerate(TRIPLES):
        value, width = np.zeros(len(fps), np.int64), 0
        for low, bits in (SEGMENTS[i] for i in triple):
            value |= ((fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)) << width
            width += bits
        # The nearest anchor, and for one block at a time those one further off.
        coded = [value >> at & block for at in (0, HAMMING_BITS)]
        off = [_NEAREST[_SYNDROMES[c]] for c in coded]
        nearest = value ^ off[0] ^ off[1] << HAMMING_BITS

        def put(anchor: np.ndarray, who: np.ndarray, number: int = number) -> None:
            keys.append((number << 40) | anchor)
            rows.append(who)

        put(nearest, every)
        for bit in range(2 * HAMMING_BITS, width):
            put(nearest ^ (1 << bit), every)
        for at, own, step in zip((0, HAMMING_BITS), coded, off, strict=True):
            syndrome = _SYNDROMES[own]
            for s in range(1, HAMMING_BITS + 1):
                who = np.flatnonzero(syndrome == s)
                for mask in _SECOND[s]:
                    put(nearest[who] ^ (step[who] ^ mask) << at, who)
    return np.concatenate(keys), np.concatenate(rows)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = ends[: len(a)], ends[len(a):]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _link_group(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of one large anchor: each step takes what is linked to a member out of the rest."""
    rest, a, b = fps, [], []
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                a.append(found)
                b.append(np.full(len(found), root, np.uint64))
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_sorted(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links inside each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for at in np.flatnonzero(sizes > _SMALL):
        x, y = _link_group(fps[starts[at]: starts[at] + sizes[at]])
        a.append(x)
        b.append(y)
    small = np.repeat(sizes <= _SMALL, sizes)
    keys, fps = keys[small], fps[small]
    for shift in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        x, y = fps[same], fps[same + shift]
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        a.append(x[near])
        b.append(y[near])
    return _forest(np.concatenate(a), np.concatenate(b))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at: at + 4096]
            keys, rows = anchors(part)
            yield pd.DataFrame({"anchor": keys, "fp": _signed(part[rows])})


def _linker(limit: int):
    """A pass over rows sorted by anchor: links, and the rows of anchors with more than ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = None  # the anchor whose rows are passed on

        def passed(key: int, fps: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"anchor": np.full(len(fps), key, np.int64), "a": _signed(fps),
                                 "b": _signed(fps)})

        def linked(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
            x, y = link_sorted(keys, fps)
            return pd.DataFrame({"anchor": pd.array([None] * len(x), "Int64"), "a": _signed(x),
                                 "b": _signed(y)})

        for batch in batches:
            keys = np.concatenate([held_keys, batch["anchor"].to_numpy(np.int64)])
            fps = np.concatenate([held, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            if over is not None:
                upto = np.searchsorted(keys, over, "right")
                if upto:
                    yield passed(over, fps[:upto])
                keys, fps = keys[upto:], fps[upto:]
                if not len(keys):
                    held_keys, held = keys, fps
                    continue
                over = None
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])
            if last:
                yield linked(keys[:last], fps[:last])
            held_keys, held = keys[last:], fps[last:]
            if len(held) > limit:
                over = int(held_keys[0])
                yield passed(over, held)
                held_keys, held = held_keys[:0], held[:0]
        if len(held):
            yield linked(held_keys, held)

    return run


def links(fps: DataFrame, scratch: Scratch, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of each component."""
    replicas = fps.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    schema = "anchor long, a long, b long"
    found = scratch.table(
        replicas.repartition("anchor").sortWithinPartitions("anchor", "fp")
        .mapInPandas(_linker(anchor_rows), schema).distinct(), "links")
    edges = found.where("anchor IS NULL").select("a", "b")
    large = found.where("anchor IS NOT NULL").selectExpr("anchor", "a AS fp")
    if large.isEmpty():
        return edges
    cells = split_anchors(large, scratch, anchor_rows)
    more = (cells.repartition("anchor", "cell").withColumn("anchor", F.xxhash64("anchor", "cell"))
            .sortWithinPartitions("anchor", "fp")
            .mapInPandas(_linker(1 << 62), schema).select("a", "b").distinct())
    return edges.unionAll(scratch.table(more, "large-links"))


def split_anchors(large: DataFrame, scratch: Scratch, anchor_rows: int) -> DataFrame:
    """Rows of large anchors in blocks: each pair of blocks is a cell, so every pair meets in a bounded task."""
    sizes = scratch.table(large.groupBy("anchor").agg(
        F.ceil(4 * F.count("*") / F.lit(anchor_rows)).cast("int").alias("blocks")), "large-anchors")
    return (large.join(sizes, "anchor")
            .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .selectExpr("anchor", "fp",
                        "concat_ws('-', least(own, other), greatest(own, other)) AS cell"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """One row per row of ``docs``: the id, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    MAX_BITS differing bits.  A null, empty or wordless text has fingerprint 0
    and links like any other.  Repeated rows and ids stay; rows without id take
    part, and their component's id is null if no member has one.  No rows give
    no rows; other columns, of any name, are not read.
    """
    spark = docs.sparkSession
    importable_in_workers(spark)
    scratch = Scratch(spark, "simhash")

    @F.pandas_udf("long")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    prints = scratch.table(
        docs.select(F.col(id_col).alias("id"), of_text(F.col(text_col)).alias("fp")), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    found = components(links(classes, scratch, anchor_rows), scratch)
    member = scratch.table(
        classes.join(found, classes.fp == found.node, "left")
        .select("fp", "low", F.coalesce("component", "fp").alias("component")), "members")
    lowest = scratch.table(member.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    named = scratch.table(member.join(lowest, "component").select("fp", "component_id"), "named")
    scratch.keep(prints, named)
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
