"""Nearest vectors: recall against brute force, exact scores and ranks, edge cases."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cspulse.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, k=20, every=20):
    """{query: [(id, score)]} by all inner products in double precision."""
    good = [(i, np.array(x, np.float64)) for i, x in rows if i is not None and x and all(
        v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scored = sorted(((-float((y * x).sum()), i) for i, y in good if i != q and len(y) == len(x)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def as_floats(x):
    return [None if v is None else float(np.float32(v)) for v in x]


def collected(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall_on_clusters(spark, norms):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 32))
    if norms:  # inner product is no cosine then
        x *= rng.uniform(0.2, 3.0, size=(3000, 1))
    rows = [(i, as_floats(v)) for i, v in enumerate(x)]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    expected = brute_force(rows)
    assert set(got) == set(expected)
    hits = 0
    for q, best in expected.items():
        assert len(got[q]) == 20
        hits += len({i for i, _ in best} & {i for i, _ in got[q]})
        exact = {i: float((np.array(rows[i][1]) * np.array(rows[q][1])).sum()) for i, _ in got[q]}
        assert all(s == exact[i] for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda g: (-g[1], g[0]))
    assert hits / (20 * len(expected)) >= 0.95


def test_fixture_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got, expected = collected(ann.nearest(table)), brute_force(rows)
    hits = sum(len({i for i, _ in best} & {i for i, _ in got[q]}) for q, best in expected.items())
    assert hits / (20 * len(expected)) >= 0.95


def test_copies_ties_and_small_tables_are_exact(spark):
    """A vector that a third of all rows share, ties to the smaller id, fewer candidates than k."""
    rng = np.random.default_rng(4)
    rows = [(i, as_floats(rng.normal(size=8))) for i in range(80)]
    rows += [(i, as_floats([1] + [0] * 7)) for i in range(80, 120)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(ann.nearest(frame)) == brute_force(rows)
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (5, [0.5, 0.5]), (20, [1.0, 2.0])]
    assert collected(ann.nearest(spark.createDataFrame(few, SCHEMA))) == brute_force(few)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0]),
            (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0, 1.0]),
            (140, [0.0, 3.0]), (140, [0.0, 3.0])]
    wide = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", score int, rank string")
    got = collected(ann.nearest(wide))
    assert got == {0: [(1, 0.5), (140, 0.0)], 140: [(1, 1.5), (0, 0.0)]}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_several_shards_and_graph_copies(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, as_floats(v)) for i, v in enumerate(rng.normal(size=(900, 16)))]
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "BLOCKS_PER_COPY", 3)
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=200))
    expected = brute_force(rows)
    hits = sum(len({i for i, _ in best} & {i for i, _ in got[q]}) for q, best in expected.items())
    assert set(got) == set(expected) and hits / (20 * len(expected)) >= 0.95


def recall(spark, x, **options):
    rows = [(i, [float(v) for v in vector]) for i, vector in enumerate(x)]
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options))
    expected = brute_force(rows)
    assert set(got) == set(expected)
    return sum(len({i for i, _ in best} & {i for i, _ in got[q]}) for q, best in expected.items()) / sum(
        map(len, expected.values()))


def clustered(n=2500, dims=32, seed=11):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(10, dims))[rng.integers(0, 10, n)] + 0.4 * rng.normal(size=(n, dims)), rng


@pytest.mark.parametrize("times", [1e3, 1e4, 1e6, 1e200])
def test_recall_beside_a_very_long_vector(spark, times):
    x, _ = clustered()
    x[1234] *= times
    assert recall(spark, x) >= 0.95


@pytest.mark.parametrize("graph_rows", [ann.GRAPH_ROWS, 100])
def test_recall_with_log_normal_lengths(spark, monkeypatch, graph_rows):
    """Most octaves small, and each with graphs of its own."""
    monkeypatch.setattr(ann, "GRAPH_ROWS", graph_rows)
    x, rng = clustered()
    assert recall(spark, x * rng.lognormal(sigma=2, size=(len(x), 1))) >= 0.95


def test_shards_do_not_depend_on_the_cluster(spark):
    """Shards come from rows and bytes; the number of cores and partitions plays no part."""
    x, _ = clustered(n=2300, dims=8)
    rows = [(i, [float(v) for v in vector]) for i, vector in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [collected(ann.nearest(frame.repartition(n), shard_rows=1000)) for n in (1, 7)]
    assert found[0] == found[1]
    assert ann._parts(100_000, 1024, 1 << 30) == -(-100_000 * (16 * 1024 + 24 * ann.LINKS) // ann.SHARD_BYTES)
    assert "defaultParallelism" not in open(ann.__file__).read()


def test_nothing_is_missed_in_several_shards(spark):
    """Vectors without any order in space, the hardest for an index: equal to brute force, not near it."""
    rng = np.random.default_rng(21)
    rows = [(i, as_floats(v)) for i, v in enumerate(rng.normal(size=(6000, 64)))]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), every=60, shard_rows=2100))
    assert got == {q: best for q, best in brute_force(rows, every=60).items()}


def test_lengths_ties_and_copies_over_many_shards(spark, monkeypatch):
    """Octaves far apart, scores that are equal for many vectors, and vectors under many ids: all exact."""
    monkeypatch.setattr(ann, "GRAPH_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(22)
    x = [[float(v) for v in c * 2.0 ** int(e)] for c, e in zip(
        rng.integers(-2, 3, size=(1500, 5)), rng.choice([-300, 0, 0, 0, 1, 300], size=1500), strict=True)]
    rows = [(i, x[i % 1400]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(ann.nearest(frame, k=9, every=7)) == brute_force(rows, k=9, every=7)


def test_an_id_with_several_vectors_takes_its_best_score(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.75, 1.0]), (2, [0.25, 0.0]), (3, [0.5, 9.0]), (0, [-1.0, 0.0])]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), k=4))
    assert got == {0: [(1, 0.75), (3, 0.5), (2, 0.25)]}


def test_more_ids_of_a_vector_than_one_query_holds(spark, monkeypatch):
    """Each id of a common vector gets its own neighbours, without itself."""
    monkeypatch.setattr(ann, "BLOCK", 3)
    n = 3 * ann.QUERY_IDS + 5
    rows = [(i, [1.0, 2.0]) for i in range(n)] + [(n, [2.0, 2.0]), (n + 1, [0.0, -1.0])]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k=3, every=1))
    assert len(got) == n + 2
    for q in (0, 1, 2, 700, n - 1):
        assert got[q] == [(n, 6.0)] + [(i, 5.0) for i in range(3) if i != q][:2]
    assert got[n] == [(i, 6.0) for i in range(3)]


def test_time_over_many_vectors(spark):
    """160,000 vectors take some 15 s; building and walking graphs over them took more than 200 s."""
    rows = spark.range(160_000).select(
        F.col("id").alias("vec_id"), F.array(*[F.randn(i).cast("float") for i in range(16)]).alias("embedding"))
    began = time.monotonic()
    assert ann.nearest(rows).agg(F.count("*"), F.countDistinct("query_id")).first()[:] == (160_000, 8_000)
    assert time.monotonic() - began < 100
