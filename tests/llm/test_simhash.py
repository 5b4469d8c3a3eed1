"""SimHash near-dedup against brute force, and its edge cases."""

from itertools import product

import numpy as np
import pytest
import xxhash

from cspulse.llm import simhash
from cspulse.llm.graph import components
from cspulse.llm.storage import Scratch


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    grams = ([b" ".join(words[i: i + shingle]) for i in range(len(words) - shingle + 1)]
             if len(words) >= shingle else [b" ".join(words)] if words else [])
    votes = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(gram, seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def plain_components(fps, bits=4):
    """Smallest position reachable over links of at most ``bits`` differing bits."""
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "one two three", "A b C d",
                                  "a b c d e f g a b c d", "é ü ß ñ x Ä\x0by", "x " * 5000])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_words_alike(spark):
    h = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", seed=42)


def test_linked_fingerprints_share_an_anchor():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y ^= 1 << int(bit)
        keys, rows = simhash.anchors(np.array([x, y], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def cloud(n, seed=3):
    """Fingerprints in a few dense clouds, and some alone."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6)
    out = {int(c) for c in centres}
    while len(out) < n:
        x = int(rng.choice(centres)) if rng.random() < 0.8 else int(rng.integers(0, 1 << 63))
        for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(bit)
        out.add(x & (1 << 64) - 1)
    return sorted(out)


@pytest.mark.parametrize("anchor_rows", [20_000, 8])
def test_links_give_all_components(spark, anchor_rows):
    """With the usual bound, and with large anchors cut into blocks."""
    fps = cloud(400)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    frame = spark.createDataFrame(signed, "fp long").repartition(3)
    scratch = Scratch(spark, "test")
    found = {r.node: r.component for r in
             components(simhash.links(frame, scratch, anchor_rows), scratch).collect()}
    expected = plain_components(fps)
    groups = {}
    for (f,), root in zip(signed, expected, strict=True):
        groups.setdefault(root, set()).add(f)
    for (f,), root in zip(signed, expected, strict=True):
        assert found.get(f, f) == min(groups[root])


def test_large_groups_inside_one_anchor():
    fps = np.array(cloud(900), np.uint64)
    a, b = simhash.link_sorted(np.zeros(len(fps), np.int64), fps)
    expected = plain_components([int(f) for f in fps])
    root = {int(x): int(y) for x, y in zip(a, b, strict=True)}

    def top(f):
        while f in root:
            f = root[f]
        return f

    groups = {}
    for f, r in zip(fps.tolist(), expected, strict=True):
        groups.setdefault(r, set()).add(top(f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (1000, 999)],
                                  "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "chain")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1000] == got[999] == 999


def test_operator_equals_brute_force_with_edge_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood " * 3
    rows = [(5, base), (3, base), (9, base.upper()), (8, base + "x"), (4, "other words entirely here ok"),
            (2, None), (1, ""), (7, " \n"), (None, base), (6, "w " * 30_000), (6, "w " * 30_000)]
    # A column that clashes with the operator's own names is left alone.
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, text string, component_id string, fp int")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in
                  simhash.simhash_components(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    assert got == sorted(((i, f, low.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)),
                         key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0


def test_any_four_bits_leave_a_triple_with_at_most_one():
    at = [i for i, (low, width) in enumerate(simhash.SEGMENTS) for _ in range(width)]
    assert len(at) == 64 and [low for low, _ in simhash.SEGMENTS] == [at.index(i) for i in range(6)]
    for spread in product(range(5), repeat=6):
        if sum(spread) == simhash.MAX_BITS:
            assert min(sum(spread[i] for i in t) for t in simhash.TRIPLES) <= 1


def test_anchors_stay_small():
    """Rows an anchor among even fingerprints: as many as 2^24 anchors a triple leave."""
    fps = np.random.default_rng(11).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    for n in (12_500, 50_000):
        keys, rows = simhash.anchors(fps[:n])
        copies = np.bincount(rows, minlength=n)
        assert 90 <= copies.mean() and copies.max() <= 102
        assert np.unique(keys, return_counts=True)[1].max() <= 6
