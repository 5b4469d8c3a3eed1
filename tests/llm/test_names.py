"""Callers' columns that have the names the operators use inside, in either case, and names they replace."""

import pytest

from cspulse.llm import (ann, fingerprints, html_text, jaccard, langid, lexical, mixing, pieces, quality, simhash,
                         spelling, tokens, urls)
from cspulse.llm.catalog import PIECE_MODEL, TOKENIZER
from cspulse.llm.expressions import others, unused

INNER = ["_source", "_row", "_host", "_path", "_score", "_q", "_p", "h", "n", "part", "kind", "block", "item", "key",
         "sketch", "stratum", "draw", "at", "fp", "shard", "payload", "surplus", "deficit", "component", "t", "id"]
TEXT = "The quick brown fox jumps over the lazy dog and then some more words follow it."


def frame(spark, fixed, rows, upper):
    """``rows`` of the columns ``fixed`` with every inner name as a further column."""
    used = {c.split()[0].lower() for c in fixed.split(", ")}
    extra = [c.upper() if upper else c for c in INNER if c not in used]
    return spark.createDataFrame([(*r, *extra) for r in rows], ", ".join([fixed, *(f"`{c}` string" for c in extra)])), extra


def documents(spark, upper):
    rows = [(i, TEXT + f" number {i}", "en", "s", 10) for i in range(6)]
    rows += [(6, None, None, None, None), (7, "", "en", "s", 0), (8, "long words " * 4000, "en", "s", 0)]
    return frame(spark, "doc_id long, text string, lang string, source string, n_chars int", rows, upper)


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("operator", [
    lambda d: pieces.round_trip(d, PIECE_MODEL), lambda d: tokens.token_counts(d, TOKENIZER), langid.identify,
    lambda d: quality.classify(d, d.sparkSession.createDataFrame(
        [(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int"))], ids=["op3", "op8", "op10", "op5"])
def test_document_operators_keep_the_callers_columns(spark, operator, upper):
    docs, extra = documents(spark, upper)
    out = operator(docs)
    lowered = [c.lower() for c in out.columns]
    assert len(lowered) == len(set(lowered)) and set(extra) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == 9 and all(r[c] == c for r in rows for c in extra)


@pytest.mark.parametrize("upper", [False, True])
def test_url_operator_keeps_the_callers_columns(spark, upper):
    pages, extra = frame(spark, "page_id long, url string", [(1, "https://a.example.com/en/x"), (2, None)], upper)
    rows = urls.judge(pages).collect()
    assert len(rows) == 2 and all(r[c] == c for r in rows for c in extra)


@pytest.mark.parametrize("name", ["IDS", "Decoded", "ROUND_TRIP"])
def test_made_columns_replace_in_either_case(spark, name):
    docs = spark.createDataFrame([(1, "some text", "old")], f"doc_id long, text string, `{name}` string")
    row = pieces.round_trip(docs, PIECE_MODEL).first()
    assert row.round_trip is True and "old" not in row


def test_made_columns_replace_in_either_case_elsewhere(spark):
    docs = spark.createDataFrame([(1, "words " * 9000, "old", "x")], "doc_id long, text string, N_TOKENS string, `_ROW` string")
    row = tokens.token_counts(docs, TOKENIZER).first()
    assert row.n_tokens > 5000 and row["_ROW"] == "x"


@pytest.mark.parametrize("upper", [False, True])
def test_operators_that_read_named_columns_only(spark, upper):
    docs, _ = documents(spark, upper)
    assert simhash.simhash_components(docs).count() == 9
    assert mixing.mix(docs).count() == 9
    assert fingerprints.edited_fingerprints(docs).count() == 9
    assert jaccard.jaccard_components(docs).count() == 9
    items, _ = frame(spark, "item_id long, text string", [(1, "quick fox")], upper)
    assert lexical.search(docs, items).count() == 6
    assert spelling.variants(docs).count() > 0
    vectors, _ = frame(spark, "vec_id long, embedding array<double>", [(0, [1.0, 0.0]), (1, [0.5, 0.5])], upper)
    assert ann.nearest(vectors).count() == 1
    pages, _ = frame(spark, "page_id long, url string, html string", [(1, "u", "<p>some text</p>")], upper)
    assert html_text.extract(pages).count() == 1


def test_helpers():
    assert unused(["a", "_X"], "_x", "_x", "b") == ["_x_", "_x__", "b"]
    assert others(["Ids", "a"], ["ids"]) == ["a"]


def test_one_id_or_row_on_a_third_of_the_rows_stays_bounded(spark, tmp_path, monkeypatch):
    """Rows that reach one language's task, with an id and a row that a third of all rows repeat."""
    rows = [(i, f"{TEXT} {i} {i * 7}", "en") for i in range(400)]
    rows += [(None, f"{TEXT} again {i}", "en") for i in range(200)] + [(5, "the same row", "en")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    # The clustering runs in a worker: it leaves the size of its group in a file.
    monkeypatch.setattr(langid, "_spherical_kmeans", _counting(str(tmp_path), langid._spherical_kmeans))
    assert langid.fit(docs, sample_per_lang=50).langs == ["en"]
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sizes and max(sizes) <= 50


def _counting(folder, plain):
    def run(x, k):
        import os
        import uuid
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
            file.write(str(len(x)))
        return plain(x, k)

    return run
