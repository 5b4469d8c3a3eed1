"""The pipeline's stages against plain versions, and its edge cases."""

from collections import Counter

import pytest

import corpus_pipeline
from cspulse.llm import langid, mixing, pieces, quality, simhash
from cspulse.llm.catalog import PIECE_MODEL
from cspulse.llm.storage import Scratch

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def as_counter(frame):
    return Counter(tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect())


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, stored."""
    scratch = Scratch(spark, "stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = scratch.table(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((docs, done))
        docs = done
    return out


def test_language_stage_drops_what_is_rejected(spark, stages):
    docs, kept = stages[0]
    expected = langid.identify(docs).where("NOT rejected")
    assert as_counter(kept) == as_counter(expected)
    assert kept.count() >= 0.99 * docs.count()


def test_quality_stage_drops_what_is_not_accepted(spark, stages):
    docs, kept = stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert as_counter(kept) == as_counter(quality.classify(docs, labels).where("accepted"))
    lost = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("quality = 1").count() == 0 and lost.where("quality = 0").count() > 0


def test_dedup_stage_keeps_the_smallest_of_each_group(stages):
    docs, kept = stages[2]
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.fingerprint(r.text, corpus_pipeline.SHINGLE) for r in rows}
    ids, low = sorted(prints), {}
    for i in ids:
        low[i] = i
    changed = True
    pairs = [(i, j) for a, i in enumerate(ids) for j in ids[a + 1:]
             if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS]
    while changed:
        changed = False
        for i, j in pairs:
            least = min(low[i], low[j])
            if low[i] != least or low[j] != least:
                low[i] = low[j] = least
                changed = True
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(low.values()))


def test_mix_stage_repeats_documents(stages):
    docs, mixed = stages[3]
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(copies) <= {r.doc_id for r in docs.select("doc_id").collect()} and max(copies.values()) <= 3
    sizes = docs.select("doc_id", "source", mixing.word_count().alias("n")).collect()
    total = Counter()
    taken = Counter()
    for r in sizes:
        total[r.source] += r.n
        taken[r.source] += r.n * copies[r.doc_id]
    order = sorted(total)
    share = sum(total.values()) / sum((5, 2, 1)[i % 3] for i in range(len(order)))
    for i, source in enumerate(order):
        assert taken[source] == pytest.approx(share * (5, 2, 1)[i % 3], rel=0.05)


def test_last_stage_encodes_every_copy(stages):
    docs, encoded = stages[4]
    own = pieces.Pieces(open(PIECE_MODEL, "rb").read())
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = encoded.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    for r in rows[:200]:
        assert r.ids == own.encode(text[r.doc_id]) and r.round_trip and own.decode(r.ids) == text[r.doc_id]
    assert all(r.round_trip for r in rows)


def test_run_equals_the_stages(spark, stages):
    done = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, done.collect())) == sorted(map(str, stages[-1][1].collect()))


def test_stages_on_edge_rows(spark):
    text = "the cat sat on the mat and slept well all day long in the sun"
    rows = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (None, "x y z other words in here now", "en", "a", 1),
            (None, text, None, None, 1), (None, "and a third one that is not like them", "en", None, None),
            (5, None, None, None, None), (6, "", None, "b", 0)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", _row string")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str(x) for x in [
        (1, text), (5, None), (None, rows[2][1]), (None, rows[4][1])])
    mixed = corpus_pipeline.source_mix(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    assert set(as_counter(mixed)) <= set(as_counter(docs))
    taken = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert mixed.count() == taken
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert stage(spark, docs, SF).count() <= 3 * len(rows)
