"""Source mixing: targets, copies, edge cases."""

import math
import random
import re

import pytest

from cspulse.llm import mixing


def plain_targets(sizes):
    """Water-filling by hand: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(3 * sizes[s] for s in fixed)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in fixed else share * weight[s] for s in order}
        fixed |= over


def documents(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["b", "b", "b", "a", "Z", "é", None]),
             "w " * int(math.exp(rnd.uniform(0, 6)))) for i in range(n)]
    rows += [(n, "a", None), (n + 1, "b", ""), (n + 2, "tiny", "one two"), (None, "a", "x y z"),
             (7, "b", "same row"), (7, "b", "same row"), (n + 3, "none", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_taken_words(spark):
    rows, docs = documents(spark)
    got = mixing.mix(docs.withColumn("size", docs.doc_id * 0)).collect()  # a clashing column
    assert len(got) == len(rows)
    by_source, words = {}, {}
    for i, source, text in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        by_source[source] = by_source.get(source, 0) + n
        words.setdefault(i, []).append((source, n))
    targets = plain_targets(by_source)
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        source, n = words[r.doc_id][0] if len(words[r.doc_id]) == 1 or r.doc_id == 7 and r.size != 2 \
            else next(x for x in words[r.doc_id] if x[1] == r.size)
        assert r.size in [x[1] for x in words[r.doc_id]]
        source = next(x[0] for x in words[r.doc_id] if x[1] == r.size)
        assert r.source_size == by_source[source]
        assert r.target == pytest.approx(targets[source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.size or not r.copies
        # A document has the certain copies of its source, or one more.
        if r.size:
            whole = math.floor(targets[source] / by_source[source] + 1e-12)
            assert r.copies in (whole, whole + 1)
        taken[source] += r.taken
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.02, abs=3)
    assert sum(targets.values()) == pytest.approx(sum(by_source.values()))


def test_reruns_agree_in_any_partitioning(spark):
    _, docs = documents(spark)

    def run(df):
        return sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df).collect())

    assert run(docs) == run(docs.repartition(5))


def test_inclusion_is_near_its_probability(spark):
    """Over many equal documents the share drawn is the fixed size, and documents differ in their draw."""
    rows = [(i, "a" if i < 900 else "b", "w " * 10) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    a = [copies[i] for i in range(900)]
    # a: 5/7 of 12000 words over 9000 words: 857 documents; b: 2/7 over 3000: 1 and 143 of 300 twice.
    assert sorted(set(a)) == [0, 1] and abs(sum(a) - 857) <= 1
    b = [copies[i] for i in range(900, 1200)]
    assert sorted(set(b)) == [1, 2] and abs(sum(b) - 343) <= 1


def test_draw_rates_match_each_documents_probability(spark):
    """Documents of one stratum of one source have different probabilities; over many seeds they are drawn at those."""
    each, seeds = 60, 4
    sizes = [64, 68, 72, 76, 80, 84, 88, 90] * each  # one half octave
    rows = [(i, "a", "w " * n) for i, n in enumerate(sizes)] + [(1000 + i, "b", "w " * 64) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    words = sum(sizes)
    mean = sum(n * n for n in sizes) / words
    # a: 5/7 of all words over its own.
    r = 5 / 7 * (words + 480 * 64) / words
    rest = r - math.floor(r)
    drawn = dict.fromkeys(sorted(set(sizes)), 0)
    for seed in range(seeds):
        for row in mixing.mix(docs, seed=f"s{seed}").collect():
            if row.doc_id < 1000:
                drawn[row.size] += row.copies - math.floor(r)
    expected = {n: rest + mixing.TILT * min(rest, 1 - rest) * (n - mean) / mean for n in drawn}
    assert max(expected.values()) - min(expected.values()) > 0.15
    for n, count in drawn.items():
        share = count / (each * seeds)
        assert abs(share - expected[n]) < 4 * math.sqrt(expected[n] * (1 - expected[n]) / (each * seeds)) + 0.02
    assert drawn[90] > drawn[64]


def test_the_draw_is_the_smallest_of_paretos_variable(spark):
    """Recomputed by hand from Spark's hash of each document: no document left out ranks before one taken."""
    rows = [(i, "a", "w " * random.Random(i).randint(5, 400)) for i in range(300)]
    rows += [(1000 + i, "b", "w " * 90) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect() if r.doc_id < 1000}
    hashes = {r.id: r.h for r in spark.createDataFrame([(i, g.size) for i, g in got.items()], "id long, size long")
              .selectExpr("id", "xxhash64('mix', id, size) AS h").collect()}
    r = next(iter(got.values()))
    rest = r.target / r.source_size - math.floor(r.target / r.source_size)
    strata = {}
    for i, g in got.items():
        strata.setdefault(math.floor(mixing.STRATA * math.log2(g.size)), []).append(i)
    checked = 0
    for ids in strata.values():
        mean = sum(got[i].size ** 2 for i in ids) / sum(got[i].size for i in ids)
        q = {}
        for i in ids:
            u = (hashes[i] % (1 << 52) + 0.5) / (1 << 52)
            p = rest + mixing.TILT * min(rest, 1 - rest) * (got[i].size - mean) / mean
            assert 0 < p < 1
            q[i] = (u / (1 - u)) / (p / (1 - p))
        more = [i for i in ids if got[i].copies > math.floor(r.target / r.source_size)]
        less = [i for i in ids if i not in set(more)]
        if more and less:
            assert max(q[i] for i in more) < min(q[i] for i in less)
            checked += 1
    assert checked >= 5


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_one_source_is_taken_once(spark):
    docs = spark.createDataFrame([(i, "a", "x " * (i + 1)) for i in range(50)],
                                 "doc_id long, source string, text string")
    assert all(r.copies == 1 for r in mixing.mix(docs).collect())


def test_plan_has_no_python(spark):
    _, docs = documents(spark, 50)
    text = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))
