"""Spelling variants against brute force, and their edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from cspulse.llm import spelling
from cspulse.llm.storage import Scratch


def plain_words(rows, every=97, min_chars=5, min_count=3):
    counts = collections.Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if plain_near(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        if around:
            best = min(around, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None)
                  for w, n in words.items())


def got(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def corpus(seed, size=40):
    """Texts over words of few letters, so that many are near."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcé", k=draw.randint(4, 8))) for _ in range(250)]
    weights = [1 / (i + 1) for i in range(250)]
    return [(i, " ".join(draw.choices(words, weights, k=120))) for i in range(size)]


@pytest.mark.parametrize("shard_words", [100_000, 20, 3])
def test_variants_equal_brute_force(spark, shard_words):
    """One shard, many shards, and shards cut into blocks."""
    rows = corpus(shard_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spelling.variants(docs, shard_words=shard_words)) == plain_variants(plain_words(rows))


def test_one_vector_in_many_blocks(spark):
    """Words of one letter-count vector and their neighbours, with blocks of a few words."""
    draw = random.Random(2)
    names = set()
    while len(names) < 120:
        word = draw.sample("aabbccd", 7)
        names.add("".join(word))
        names.add("".join(word)[:-1])
    words = {w: draw.randint(3, 50) for w in names}
    frame = spark.createDataFrame(sorted(words.items()), "word string, n long")
    found = {r.word: r.n_near for r in spelling.near_words(frame, Scratch(spark, "test"), 4).collect()}
    for w in words:
        assert found.get(w, 0) == sum(plain_near(w, v) for v in words)


def test_edge_rows_and_clashing_columns(spark):
    long = "aaaaa" * 4000
    rows = [(1, None), (2, ""), (3, "123 ... a bb"), (None, "Hello HELLO hello hallo hello, hello"),
            (4, f"{long} {long} {long} {long}b {long}b {long}b {long}b {long}b {long}b"),
            (5, "Äpfel Äpfel Äpfel äpfel äpfel äpfel äpfel äpfel äpfel xäpfel÷x"),
            (5, "hullo hullo hullo hellos hellos hellos"), (5, "hullo hullo hullo hellos hellos hellos")]
    docs = spark.createDataFrame([(*r, "w", 1, "f") for r in rows],
                                 "doc_id long, text string, word string, N int, form string")
    for every in (97, 3, None):
        assert got(spelling.variants(docs, typo_every=every)) == plain_variants(plain_words(rows, every))
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_one_edit_and_the_bulk_check_agree(seed):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(1, 70))) for _ in range(60)})
    words = sorted({*words, *(w[:i] + draw.choice(["", "a", "b"]) + w[i + 1:] for w in words
                              for i in [draw.randrange(len(w))])} - {""})
    raw = [w.encode() for w in words]
    pairs = spelling._Pairs(raw, np.ones(len(raw), np.int64))
    a, b = np.triu_indices(len(raw), 1)
    pairs.add(a, b)
    pairs.flush()
    expected = [sum(plain_near(w, v) for v in words) for w in words]
    assert pairs.near.tolist() == expected
    assert [sum(spelling.one_edit(x, y) for y in raw) for x in raw] == expected


def test_root_follows_a_long_chain(spark):
    chain = [f"w{i:03d}" for i in range(40)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    ends = {r.word: r.root for r in spelling.roots(forms, Scratch(spark, "test")).collect()}
    assert ends == {w: chain[-1] for w in chain[:-1]}
