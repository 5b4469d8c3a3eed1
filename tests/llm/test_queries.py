"""The registered queries: contracts' columns, whole tables, agreement with plain versions."""

import glob
import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cspulse.llm import catalog, simhash, tokens
from cspulse.llm.storage import release
from cspulse.session import checkpoint_root

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double",
                       "taken": "bigint"},
    "op3_sentencepiece": {"doc_id": "bigint", "ids": "array<int>", "decoded": "string", "round_trip": "boolean"},
    "op4_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string",
                       "verdict": "string"},
    "op5_quality_cotraining": {"doc_id": "bigint", "score": "double", "accepted": "boolean"},
    "op6_html_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_nearest_vectors": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string",
                                  "fingerprint": "string", "edited_fingerprint": "string",
                                  "near_edited": "double", "near_next": "double"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op12_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint",
                               "n_near": "bigint", "form_n": "bigint"},
}


def left(spark):
    """Parquet files in the checkpoint folder."""
    return set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/**/*.parquet", recursive=True))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_per_operator_and_the_pipeline():
    assert set(catalog.queries()) == set(COLUMNS)
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, documents, name):
    before = left(spark)
    frame = entry.queries()[name](spark, SF)
    kinds = dict(frame.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = frame.collect()
    if "doc_id" in kinds and "rank" not in kinds:
        assert sorted(r.doc_id for r in rows) == sorted(documents)
    elif "page_id" in kinds:
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    release(frame)
    assert left(spark) == before
    again = entry.queries()[name](spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_fingerprints_and_counts_on_whole_texts(spark, documents):
    for r in entry.queries()["op1_simhash_near_dedup"](spark, SF).collect():
        assert r.fingerprint == f"{simhash.fingerprint(documents[r.doc_id].text):016x}"
    with open(catalog.TOKENIZER, "rb") as file:
        tok = tokens._tokenizer(file.read())
    for r in entry.queries()["op8_token_counts"](spark, SF).collect():
        text = documents[r.doc_id].text or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_edited_texts(spark, documents):
    ids = sorted(documents)
    got = {r.doc_id: r for r in entry.queries()["op9_document_fingerprints"](spark, SF).collect()}
    for at, i in enumerate(ids):
        text, after = (documents[j].text or "" for j in (i, ids[(at + 1) % len(ids)]))
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = {}
    for i in ids:
        by_text.setdefault(documents[i].text, set()).add(got[i].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_pipeline_query_runs(spark):
    before = left(spark)
    frame = entry.queries()["pipeline"](spark, SF)
    rows = frame.collect()
    assert rows and all(r.round_trip for r in rows)
    assert all("/pipeline-" in f for f in left(spark) - before)
    release(frame)
    assert left(spark) == before
