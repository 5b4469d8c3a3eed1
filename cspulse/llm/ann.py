"""Nearest neighbours by inner product: every query with every vector, by matrix products.

Vectors are dealt into shards by a hash.  A task holds one shard and the queries
go past it in blocks: a matrix product in single precision gives a block's
scores with a stretch of the shard, and those that a bound on the rounding
cannot rule out of the block's best are scored again in double precision.  So
nothing is missed, and ranks and scores are those of double precision.

Each vector is scaled by the power of two next to its length, so that vectors of
any length, also beside each other, keep the full precision; scores are compared
with the powers put back.

The shards follow from the vectors alone, not from the cluster: at most
SHARD_ROWS rows and SHARD_BYTES each, and SPREAD of them where each then has
GRAPH_ROWS.

Equal vectors are one node and one query.  A node needs only its smallest ids: no
result holds more than k of them, and one may be the query itself.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch, importable_in_workers

#: Vectors of a shard and their bytes at most; 24 * LINKS bytes of a vector are for what goes with it.
SHARD_ROWS = 1 << 19
SHARD_BYTES = 384 << 20
LINKS = 16
#: Shards of a large table at least, and vectors that such a shard has at least.
SPREAD = 16
GRAPH_ROWS = 16384
#: Queries of a block, ids that one of them has at most, blocks that one copy of a shard serves.
BLOCK = 512
QUERY_IDS = 1024
BLOCKS_PER_COPY = 2048
#: Vectors of a shard that are multiplied at once, those that give the first bound, and candidates of a query that wait
#: to be sorted.
STRETCH = 256
FIRST = 8192
HELD = 128
#: Rows and bytes of vectors that travel as one value, and bytes that wait for that.
PACK_ROWS = 4096
PACK_BYTES = 1 << 20
WAITING = 32 << 20

NODES = "vector binary, low binary, queries binary"
PACKS = "kind int, dims int, part int, pack long, payload binary"


def _lengths(x: np.ndarray) -> np.ndarray:
    """Norm of each row; scaled first, so that no square leaves the range of doubles."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows that take part, by length of the vectors."""
    batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # null: nan
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dims)
        x = values[starts[at][:, None] + np.arange(dims)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield ids[at[good]], x[good] + x.dtype.type(0)  # -0.0 is 0.0


def _distinct(k: int, every: int):
    """A pass over (id, vector): a batch's distinct vectors with their k + 1 smallest ids and the ids to ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _usable(batch):
                width, raw = x.shape[1] * x.itemsize, x.tobytes()
                vectors = [raw[i : i + width] for i in range(0, len(raw), width)]
                found: dict[bytes, list[int]] = {}
                for vector, i in zip(vectors, ids.tolist(), strict=True):
                    found.setdefault(vector, []).append(i)
                low, asked = [], []
                for own in found.values():
                    own = sorted(set(own)) if len(own) > 1 else own
                    low.append(np.array(own[: k + 1], np.int64).tobytes())
                    asked.append(np.array([i for i in own if i % every == 0], np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(low, pa.binary()), pa.array(asked, pa.binary())],
                    names=["vector", "low", "queries"])

    return run


def _united(values: list[bytes]) -> np.ndarray:
    ids = np.frombuffer(b"".join(values), np.int64)
    return ids if len(values) == 1 else np.unique(ids)


def _packer(k: int, kind: np.dtype, parts: dict[int, int], block: int):
    """A pass over rows sorted by vector: packs of vectors by shard (kind 0) and blocks of queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[bytes, np.ndarray]]] = {}  # part -1: queries
        held = made = 0
        first = TaskContext.get().partitionId() << 32

        def pack(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal held, made
            rows = waiting.pop(key)
            held -= sum(len(v) for v, _ in rows)
            payload = pickle.dumps((np.frombuffer(b"".join(v for v, _ in rows), kind).reshape(len(rows), key[0]),
                                    np.concatenate([i for _, i in rows]), np.array([len(i) for _, i in rows])), 5)
            made += 1
            values = [int(key[1] < 0), *key, first + made, payload]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()),
                                                  strict=True)], names=["kind", "dims", "part", "pack", "payload"])

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for vector, same in groupby(rows, key=lambda row: row[0]):
            _, low, asked = zip(*same, strict=True)
            dims = len(vector) // kind.itemsize
            part = zlib.crc32(vector) % parts[dims]
            asked = _united(list(asked))
            entries = [((dims, part), _united(list(low))[: k + 1])]
            entries += [((dims, -1), asked[i : i + QUERY_IDS]) for i in range(0, len(asked), QUERY_IDS)]
            for key, ids in entries:
                own = waiting.setdefault(key, [])
                own.append((vector, ids))
                held += len(vector)
                if len(own) >= (block if key[1] < 0 else PACK_ROWS) or len(own) * len(vector) >= PACK_BYTES:
                    yield pack(key)
            if held >= WAITING:
                for key in list(waiting):
                    yield pack(key)
        for key in list(waiting):
            yield pack(key)

    return run


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run."""
    return np.repeat(starts - _starts(sizes), sizes) + np.arange(int(sizes.sum()))


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Position of each element of a sorted array among its equals."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _most(among: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often the sorted ``among`` holds one of each run of ids, at most."""
    return np.maximum.reduceat(np.searchsorted(among, ids, "right") - np.searchsorted(among, ids), _starts(sizes))


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the few true ones."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


class Shard:
    """Vectors with their ids, longest octave first."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.ids = np.concatenate([ids for _, ids, _ in packs])
        self.sizes = np.concatenate([sizes for _, _, sizes in packs])
        n, dims = len(self.sizes), packs[0][0].shape[1]
        self.x = np.empty((n, dims), packs[0][0].dtype)
        packs.reverse()
        at = 0
        while packs:  # one by one: they are as large as what is made of them
            x = packs.pop()[0]
            self.x[at : at + len(x)] = x
            at += len(x)
        octave = np.empty(n, np.int32)
        for i in range(0, n, FIRST):
            octave[i : i + FIRST] = np.floor(np.log2(_lengths(self.x[i : i + FIRST].astype(np.float64))) + 0.5)
        self.starts = _starts(self.sizes)
        if (octave != octave[0]).any():
            order = np.argsort(-octave, kind="stable")
            octave, self.x = octave[order], self.x[order]
            self.starts, self.sizes = self.starts[order], self.sizes[order]
        #: Scores of scaled vectors are in units of 2 ** below[row], relative to the longest octave.
        self.top, self.below = int(octave[0]), octave - octave[0]
        cuts = [0, *(np.flatnonzero(np.diff(octave)) + 1).tolist(), n]
        self.longest = cuts[1]
        self.stretches = [(i, min(i + STRETCH, end)) for start, end in zip(cuts, cuts[1:], strict=False)
                          for i in range(start, end, STRETCH)]
        # The rounding of a product of scaled vectors is below half of this.
        self.off = (dims + 8) * 2.0 ** -22
        self.low = self.ids[self.starts]
        shared = self.sizes > 1
        self.all_ids = np.sort(self.ids)
        self.shared_ids = np.sort(self.ids[_spread(self.starts[shared], self.sizes[shared])])

    def scaled(self, start: int, end: int) -> np.ndarray:
        """Some rows of one octave in single precision."""
        octave, x = self.top + int(self.below[start]), self.x[start:end]
        if octave == 0 and x.dtype == np.float32:
            return x
        return np.ldexp(x.astype(np.float64), -octave).astype(np.float32)

    @np.errstate(over="ignore", invalid="ignore")
    def best(self, queries: np.ndarray, ids: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, id, score): of each query at least the k best ids that are none of its own."""
        n = len(queries)
        few = np.min_scalar_type(n)  # sorted by its digits
        exact = queries.astype(np.float64)
        unit = (exact / _lengths(exact)[:, None]).astype(np.float32)
        alone, first = sizes == 1, ids[_starts(sizes)]
        repeats = _most(self.all_ids, ids, sizes)
        # Its own ids may be in so many of the rows that are not left out below.
        keep = k + np.maximum(1, np.where(alone, _most(self.shared_ids, ids, sizes), repeats))
        # The keep-th best score, relative, or less.
        bound = np.full(n, -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def sift() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What can still be among the best of all so far."""
            who, row, least = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(-least)
            order = order[np.argsort(who[order].astype(few), kind="stable")]
            who, row, least = who[order], row[order], least[order]
            found = np.bincount(who, minlength=n)
            full = np.flatnonzero(found >= keep)
            bound[full] = np.maximum(bound[full], least[_starts(found)[full] + keep[full] - 1])
            may = least + np.ldexp(2 * self.off, self.below[row]) >= bound[who]
            return who[may], row[may], least[may]

        def take(scores: np.ndarray, start: int) -> None:
            nonlocal held, waiting
            below = int(self.below[start])
            at = _set(scores >= (np.ldexp(bound, -below) - self.off).astype(np.float32)[:, None])
            if not len(at):
                return
            who, row = np.divmod(at, scores.shape[1])
            row += start
            least = np.ldexp(scores.reshape(-1)[at].astype(np.float64) - self.off, below)
            own = alone[who] & (self.sizes[row] == 1) & (first[who] == self.low[row])
            if own.any():
                who, row, least = who[~own], row[~own], least[~own]
            held.append((who, row, least))
            waiting += len(who)
            if waiting > HELD * n:
                held = [sift()]
                waiting = 0

        # The best of blocks of the first rows give the first bound.
        done, most = 0, int(keep.max())
        wide = max(1, min(self.longest, FIRST) // (4 * most))
        blocks = min(self.longest, FIRST) // wide
        if blocks > most:
            done = blocks * wide
            scores = unit @ self.scaled(0, done).T
            highest = np.partition(scores.reshape(n, blocks, wide).max(axis=2), blocks - most, axis=1)[:, blocks - most]
            bound = np.where(repeats > 1, -np.inf, highest - self.off)
            take(scores, 0)
            del scores
        out = np.empty(n * STRETCH, np.float32)

        for start, end in self.stretches:
            start = max(start, done)
            if start < end:
                scores = out[: n * (end - start)].reshape(n, end - start)
                take(np.matmul(unit, self.scaled(start, end).T, out=scores), start)
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        who, row, _ = sift()
        score = np.empty(len(who))
        step = max(1, (1 << 21) // self.x.shape[1])
        for i in range(0, len(who), step):
            score[i : i + step] = (self.x[row[i : i + step]].astype(np.float64) * exact[who[i : i + step]]).sum(axis=1)
        order = np.lexsort((self.low[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        kept = _ranks(who) < keep[who]
        who, row, score = who[kept], row[kept], score[kept]
        size = self.sizes[row]
        if (size == 1).all():
            return who, self.low[row], score
        found = self.ids[_spread(self.starts[row], size)]
        who, score = np.repeat(who, size), np.repeat(score, size)
        order = np.lexsort((found, -score, who))
        order = order[_ranks(who[order]) < keep[who[order]]]
        return who[order], found[order], score[order]


def _searcher(k: int):
    """A pass over packs sorted by (shard, copy, kind): each block's best of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packs = None, []
        for batch in batches:
            for kind, pack, payload in zip(batch.column("kind").to_pylist(), batch.column("pack").to_pylist(),
                                           batch.column("payload"), strict=True):
                value = pickle.loads(payload.as_buffer())
                if kind == 0:
                    shard = None
                    packs.append(value)
                    continue
                if packs:
                    shard, packs = Shard(packs), []
                who, found, score = shard.best(*value, k)
                out = pickle.dumps((*value[1:], who.astype(np.int32), found, score), 5)
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([out], pa.binary())],
                                                 names=["pack", "payload"])

    return run


def _merger(k: int):
    """A pass over the shards' best sorted by block: (query_id, vec_id, score) of the k best of all."""

    def best(found: list[bytes]) -> Iterator[pa.RecordBatch]:
        values = [pickle.loads(payload) for payload in found]
        ids, sizes = values[0][:2]
        who, near, score = (np.concatenate(c) for c in zip(*(v[2:] for v in values), strict=True))
        order = np.lexsort((near, -score, who))
        near, score = near[order], score[order]
        counts = np.bincount(who, minlength=len(sizes))
        starts, entries = _starts(counts), np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, (1 << 20) // max(1, int(counts.max(initial=0))))
        for i in range(0, len(ids), step):
            query, entry = ids[i : i + step], entries[i : i + step]
            at = _spread(starts[entry], counts[entry])
            line = np.repeat(np.arange(len(query)), counts[entry])
            other = near[at] != query[line]
            at, line = at[other], line[other]
            kept = _ranks(line) < k
            at, line = at[kept], line[kept]
            yield pa.RecordBatch.from_arrays([pa.array(query[line]), pa.array(near[at]), pa.array(score[at])],
                                             names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, same in groupby(rows, key=lambda row: row[0]):
            yield from best([payload for _, payload in same])

    return run


def _parts(rows: int, dims: int, shard_rows: int) -> int:
    """Shards of so many vectors: from rows and bytes alone."""
    return max(1, -(-rows // shard_rows), -(-rows * (16 * dims + 24 * LINKS) // SHARD_BYTES))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row whose id is divisible by ``every``.

    Vectors that are null, zero or hold a null or non-finite component, and rows
    without id, take no part; vectors of other lengths are no candidates.  Ties
    go to the smaller id.  Rows that repeat an id are one query each with its
    own vector's neighbours only if the vectors are equal; of different vectors
    under one id each is a candidate and the id takes its best score.  No rows
    give no rows; other columns are not read.  ``beam`` was the width of a search
    in graphs; every vector is compared now, whatever it is.
    """
    spark = vectors.sparkSession
    importable_in_workers(spark)
    scratch = Scratch(spark, "ann")
    single = dict(vectors.select(F.col(vector_col).alias("x")).dtypes)["x"] == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    # A row comes to the driver for every length of vectors.
    sizes = (rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
             .groupBy(F.size("embedding").alias("dims"))
             .agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.dtype(np.float32 if single else np.float64)
    parts = {dims: max(_parts(n, dims * kind.itemsize // 8 or 1, shard_rows), min(SPREAD, n // GRAPH_ROWS))
             for dims, n, _ in sizes}
    plan = [(dims, parts[dims], max(1, -(-n // (BLOCK * BLOCKS_PER_COPY)))) for dims, _, n in sizes]
    packs = scratch.table(
        rows.mapInArrow(_distinct(k, every), NODES).repartition("vector").sortWithinPartitions("vector")
        .mapInArrow(_packer(k, kind, parts, BLOCK), PACKS), "packs")
    scratch.keep(packs)
    dealt = F.broadcast(spark.createDataFrame(plan, "dims int, parts int, copies int"))
    packs = packs.join(dealt, "dims")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = packs.where("kind = 0").withColumn("copy", spread("copies"))
    asked = packs.where("kind = 1").withColumn("copy", F.pmod("pack", "copies").cast("int"))
    work = held.unionByName(asked.withColumn("part", spread("parts")))
    # More tasks than shards, so that few share one.
    tasks = 4 * sum(n * copies for _, n, copies in plan)
    found = (work.select("dims", "part", "copy", "kind", "pack", "payload").repartition(tasks, "dims", "part", "copy")
             .sortWithinPartitions("dims", "part", "copy", "kind", "pack")
             .mapInArrow(_searcher(k), "pack long, payload binary"))
    merged = (found.repartition("pack").sortWithinPartitions("pack")
              .mapInArrow(_merger(k), "query_id long, vec_id long, score double")
              .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (merged.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
