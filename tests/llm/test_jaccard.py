"""N-gram Jaccard join against brute force, and its edge cases."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from cspulse.llm import jaccard
from cspulse.llm.storage import Scratch


def plain_set(text, shingle=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < shingle:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + shingle]) for i in range(len(words) - shingle + 1))


def plain_components(rows, percent=80):
    """Expected (id, size, component) of rows (id, text), as a sorted list."""
    sets = [plain_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[top(i)] = min(low.get(top(i), name), name)
    return sorted(((name, len(s), low.get(top(i)) if s else name)
                   for i, ((name, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "one two three", "A b C d E", "a b c d e f a b c d e f",
                                  "é ü ß ñ x Ä\x0by z", "x " * 5000])
def test_set_sizes_equal_the_definition(text):
    assert len(jaccard.shingle_set(text)) == len(plain_set(text))


def near_copies(seed, groups, copies, edits):
    """Random texts, each with copies of a few replaced words; some share a long passage."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = draw.choices(words, k=25)
    rows = []
    for _ in range(groups):
        base = draw.choices(words, k=draw.randint(3, 120))
        if draw.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2:]
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_components_equal_brute_force(spark, rounds):
    """The same with leader rounds and with every candidate pair counted at once."""
    rows = near_copies(rounds, 25, 9, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.jaccard_components(docs, rounds=rounds, fragments=3)) == plain_components(rows)


def test_a_large_group_is_joined_without_its_pairs(spark):
    """A chain of near copies and a frequent passage: far fewer pairs are counted than the group has."""
    draw = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(docs)) == plain_components(rows)
    counted = []
    plain = jaccard.similar

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return plain(pairs, *rest)

    jaccard.similar = counting
    try:
        jaccard.jaccard_components(docs).collect()
    finally:
        jaccard.similar = plain
    assert sum(counted) < 3 * len(rows)


def test_pairs_on_both_sides_of_the_bound(spark):
    """20 of 25 shingles in common are enough, 19 of 25 and 20 of 26 are not."""
    common = [f"c{i}" for i in range(24)]  # 20 shingles
    rows = [(0, " ".join(common)), (1, " ".join([*common, "p", "q", "r", "s", "t"])),
            (2, " ".join(["o", *common, "u", "v", "w", "x", "y"])),
            (3, " ".join([*common[:23], *"abcdef"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(jaccard.jaccard_components(docs))
    assert found == plain_components(rows) and found[1][2] == 0 and found[2][2] == 2


def test_edge_rows_and_clashing_columns(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood"
    rows = [(5, base), (3, base), (9, base.upper()), (8, base + " x"), (4, "other words entirely here ok"),
            (2, None), (1, ""), (7, " \n"), (None, base), (None, None), (6, "w " * 30_000), (6, "w " * 30_000),
            (11, "few words"), (10, "FEW\twords"), (12, "few  words here")]
    clash = ["component_id", "KEY", "h", "n", "t", "id0", "none", "head"]
    docs = spark.createDataFrame([(*r, *clash) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    assert got(jaccard.jaccard_components(docs)) == plain_components(rows)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_screen_loses_no_partner(spark):
    """Classes that the screen leaves out have no similar class."""
    rows = near_copies(3, 60, 3, 6)
    sets = {i: jaccard.shingle_set(t) for i, t in rows}
    prints = []
    for i, s in sets.items():
        lack = len(s) - int(jaccard._least(np.int64(len(s)), 80))
        prints.append((i + 1, len(s), s[: lack + -(-len(s) * jaccard.EXTRA // 100)].tobytes()))
    frame = spark.createDataFrame(prints, "key long, n long, head binary").repartition(4)
    kept = {r.key - 1 for r in jaccard.screened(frame, 80).collect()}
    for i, s in sets.items():
        similar = any(j != i and 100 * len(np.intersect1d(s, r)) >= 80 * len(np.union1d(s, r)) for j, r in sets.items()
                      if not np.array_equal(s, r))
        assert i in kept or not similar


def test_shared_counts_across_batches():
    """A shingle's rows may be cut anywhere between two batches."""
    rows = pd.DataFrame({"h": [1, 1, 2, 3, 3, 3, 4, 4, 5], "who": [7, 8, 7, 0, 7, 9, 7, 7, 9],
                         "times": [0, 0, 0, -1, 0, 0, 0, 0, 0], "need": 0})
    for cut in range(len(rows) + 1):
        parts = [p for p in (rows[:cut], rows[cut:]) if len(p)]
        found = pd.concat(list(jaccard._shared(iter(parts))))
        assert found.groupby("who")["times"].sum().to_dict() == {7: 2, 8: 1, 9: 1}


def test_bitmap_keeps_every_wanted_row(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS t")
    wanted = rows.where("t % 7 = 0")
    kept = jaccard.in_bitmap(rows, wanted, "t")
    assert wanted.exceptAll(kept).isEmpty() and kept.count() < 1.2 * wanted.count()


def test_fragments_cover_each_ordered_set_once(spark):
    rows = near_copies(5, 20, 6, 3)
    sets = spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, t in rows
                                  if len(s := jaccard.shingle_set(t))], "key long, n long, tokens array<long>")
    orders = Scratch(spark, "test").table(jaccard.ordered(sets, 80), "orders")
    parts = {}
    for r in jaccard.segmented(orders, 4).collect():
        parts.setdefault(r.key, {})[r.fragment] = r.part
    for r in orders.collect():
        joined = [h for f in sorted(parts[r.key]) for h in parts[r.key][f]]
        assert joined == [o.h for o in r.ord]
        assert [tuple(o) for o in r.ord] == sorted(tuple(o) for o in r.ord)
    assert len({f for p in parts.values() for f in p}) > 1


def test_small_tables_are_few_files(spark, monkeypatch):
    """Labels, pairs and components are not written as one file a shuffle partition; the results are the same."""
    files = {}
    plain = Scratch.table

    def counting(self, df, name, *rest, **kind):
        out = plain(self, df, name, *rest, **kind)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "table", counting)
    changed = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    rows = near_copies(11, 30, 8, 3)
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain_components(rows)
    assert {"pairs", "links", "stars", "named"} <= set(files)
    own = {"heads", "sets", "orders", "segments"}
    assert max(n for name, n in files.items() if name not in own) <= spark.sparkContext.defaultParallelism
