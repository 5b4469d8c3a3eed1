"""Bottom-k fingerprints against exact shingle sets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cspulse.llm import fingerprints as fp


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=120, seed=6):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 5, 40, 90, 400]))) for _ in range(n)]


def test_edited_texts_and_likenesses(spark):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.edited, r.n_chars) == (edited, len(text))
        a, b, c = shingles(text), shingles(edited), shingles(after)
        small = max(len(a | b), len(a | c)) <= fp.K
        assert r.near_edited == pytest.approx(jaccard(a, b), abs=1e-9 if small else 0.2)
        assert r.near_next == pytest.approx(jaccard(a, c), abs=1e-9 if small else 0.2)
        assert r.shingles == pytest.approx(len(a), rel=1e-9 if len(a) < fp.K else 0.35)


def test_mean_error_of_estimates(spark):
    rows = [(i, " ".join(f"v{(7 * i + j) % 5000}" for j in range(900))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    errors = []
    for i, text in rows:
        a, b = shingles(text), shingles(got[i].edited)
        errors.append(abs(got[i].near_edited - jaccard(a, b)))
    assert sum(errors) / len(errors) < 0.05


def test_sketches_merge_across_parts(spark):
    rnd = random.Random(1)
    parts = [("a" if rnd.random() < 0.9 else None, t) for t in texts(60, 2)]
    frame = spark.createDataFrame(parts, "k string, text string").select(
        "k", fp.sketch(F.col("text")).alias("sketch"))
    merged = {r.k: r.sketch for r in fp.merge_groups(frame, "k").collect()}
    for key in ("a", None):
        hashes = set()
        for r in frame.where(F.col("k").eqNullSafe(F.lit(key))).collect():
            hashes |= set(r.sketch)
        assert merged[key] == sorted(hashes)[: fp.K]


def test_order_of_edge_rows(spark):
    rows = [(2, "b b b b b b b b"), (None, "null id text goes here now"), (1, None), (9, "z" * 50_000 + " q"),
            (9, "second text of nine"), (2, "b b b b b b b b"), (5, ""), (6, "日本語😀é" * 9)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, h string, n_chars int")
    got = fp.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    nine = sorted((t for i, t in rows if i == 9),
                  key=lambda t: spark.sql("SELECT xxhash64(:t) AS h", args={"t": t}).first().h)
    ring = [(None, rows[1][1]), (1, ""), (2, rows[0][1]), (5, ""), (6, rows[7][1]), (9, nine[0]), (9, nine[1])]
    expected = {}
    for at, (i, text) in enumerate(ring):
        after, cut = ring[(at + 1) % len(ring)][1], len(text) // 4
        expected[i, hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] = len(text)
    assert {(r.doc_id, hashlib.sha256(r.edited.encode()).hexdigest()): r.n_chars for r in got} == expected
    same = [r for r in got if r.doc_id == 2]
    assert len(same) == 2 and same[0] == same[1]
    empty = next(r for r in got if r.doc_id == 5)
    assert empty.sketch == [] and empty.near_edited == 1.0


def test_single_document_and_empty_table(spark):
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    r = fp.edited_fingerprints(one).first()
    assert r.edited == "abcd ef" + "ab" and r.near_next == 1.0
    assert fp.edited_fingerprints(one.where("false")).count() == 0


def test_texts_are_shuffled_once_and_without_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20))], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = fp.edited_fingerprints(docs)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan or plan.count("Exchange hashpartitioning(id0") <= 3
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
