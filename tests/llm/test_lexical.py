"""Ranked search against brute force, and its edge cases."""

import collections
import math
import random
import re

import pytest

from cspulse.llm import lexical
from cspulse.llm.storage import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=50):
    """Expected (item, rank, document, score), sorted."""
    bags = [(name, collections.Counter(plain_terms(text))) for name, text in docs]
    documents = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for name, bag in bags:
            score = 0
            for t in set(plain_terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * sum(bag.values()) * documents) // total
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scores.append((-score, name is None, name))
        out += [(item, at + 1, name, -score) for at, (score, _, name) in
                enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def corpus(seed=1, size=120):
    draw = random.Random(seed)
    words = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for i in range(size)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(0, 8)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "group_items": 4}, {"vocabulary_bytes": 0, "k": 5},
                                     {"k": 1000, "block_docs": 1}])
def test_ranking_equals_brute_force(spark, options):
    """Whole blocks, small blocks and groups, an index of every term, more places than documents."""
    docs, items = corpus()
    frame = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                           spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got(frame) == plain_search(docs, items, options.get("k", 50))


def test_edge_rows_ties_and_clashing_columns(spark):
    long = "rare " + "filler " * 40_000
    docs = [(4, "Alpha beta"), (2, "alpha BETA"), (9, "alpha beta"), (9, "alpha beta"), (None, "alpha beta"),
            (None, "alpha"), (7, None), (8, ""), (6, "... --- \n"), (5, long), (3, "Ärger ärger 123 a_b"), (1, "x y z"),
            *((100 + i, "common") for i in range(30))]
    items = [(1, "alpha beta alpha"), (1, "alpha beta alpha"), (1, "rare"), (2, None), (3, ""), (4, "?!"),
             (5, "ärger"), (6, "Ärger 123 b A"), (7, "unknown term"), (None, "beta"), (8, "common")]
    clash = ["rank", "SCORE", "block", "term", "items", "w"]
    frame = spark.createDataFrame([(*d, *clash) for d in docs],
                                  "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, name string, item string")
    assert got(lexical.search(frame, asked, k=4, block_docs=5)) == plain_search(docs, items, 4)


def test_empty_tables(spark):
    docs, items = corpus()
    docs, items = (spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string"))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", lexical.F.lit(None).cast("string")), items).count() == 0


def test_every_owner_has_work(spark):
    """Rare and frequent terms go to different owners, each adding to the same documents."""
    docs = [(i, "every " + ("half " if i % 2 else "") + ("some " if i % 20 == 0 else "")
             + ("few " if i % 150 == 0 else "") + ("one" if i == 1200 else "")) for i in range(1500)]
    items = [(1, "every half some few one"), (2, "one every")]
    frame = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), block_docs=200)
    assert got(frame) == plain_search(docs, items)


@pytest.mark.parametrize("vocabulary_bytes", [lexical.VOCABULARY_BYTES, 0])
def test_few_items_leave_posting_lists_where_they_are(spark, monkeypatch, vocabulary_bytes):
    """With a short item list no posting list is shuffled by term or written twice, and the items' tables are
    few files; the results are the same."""
    columns, files = {}, {}
    plain = Scratch.table

    def noting(self, df, name, *rest, **kind):
        out = plain(self, df, name, *rest, **kind)
        columns[name], files[name] = set(df.columns), len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "table", noting)
    changed = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    docs, items = corpus(2)
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = got(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string"),
                                   vocabulary_bytes=vocabulary_bytes, block_docs=50, group_items=4))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain_search(docs, items)
    assert [n for n, c in columns.items() if "docs" in c] == (["index"] if vocabulary_bytes else ["index", "postings"])
    assert max(n for name, n in files.items() if "docs" not in columns[name]) <= spark.sparkContext.defaultParallelism
