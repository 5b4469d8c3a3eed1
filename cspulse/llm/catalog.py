"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, fingerprints, html_text, jaccard, langid, lexical, mixing, pieces, quality, simhash, spelling,
               tokens, urls)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document's whole text, and whether they decode to it."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, PIECE_MODEL).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded", "round_trip")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.classify(docs, labels).select("doc_id", "score", "accepted")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, TOKENIZER).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likenesses."""
    found = fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.text_of(F.col("sketch")).alias("fingerprint"),
        fingerprints.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "contained", "shingles")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(_read(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words' number, its form and the root of its forms."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_source_mix, op3_sentencepiece,
                            op4_url_filter, op5_quality_cotraining, op6_html_main_text,
                            op7_nearest_vectors, op8_token_counts, op9_document_fingerprints, op10_language_id,
                            op11_ngram_jaccard_join, op12_ranked_search, op13_spelling_variants)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query of each operator by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator."""
    return {}
