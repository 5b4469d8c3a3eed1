"""A training corpus from ``documents`` in five stages, each a Parquet table for the next.

Every stage function takes (spark, docs, sf_dir); all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cspulse.llm import langid, mixing, pieces, quality, simhash
from cspulse.llm.catalog import PIECE_MODEL
from cspulse.llm.storage import Scratch, release

#: Columns of documents; a stage passes on these alone.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle for SimHash, as in the operator's own query.
SHINGLE = 4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.identify(docs).where(~F.col("rejected")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``sf_dir``, accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.classify(docs, labels).where("accepted").select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, equal for equal rows: (id is null, id, hash of the row), so ordered by id."""
    return docs.select(*COLUMNS).withColumn(
        "_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("h")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, rows without id last.

    Of different rows under that id the one of the smallest row hash stays.
    """
    rows = _named(docs)
    groups = simhash.simhash_components(rows, id_col="_row", shingle=SHINGLE)
    keep = groups.where("_row = component_id").select("_row").distinct()
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it, at most three."""
    rows = _named(docs)
    # Repeated rows were drawn apart; together they are taken so many times.
    taken = (mixing.mix(rows, id_col="_row").groupBy("_row").agg(F.sum("copies").alias("_copies"))
             .where("_copies > 0"))
    return (rows.join(taken, "_row").dropDuplicates(["_row"])
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return pieces.round_trip(docs.select("doc_id", "source", "text"), PIECE_MODEL).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [("language ID", language_id), ("quality classifier", quality_filter),
          ("SimHash near-dedup", near_dedup), ("source mix", source_mix),
          ("SentencePiece", encode_pieces)]

#: No SQL expresses the fitted stages; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in ``sf_dir``.

    A stage's table goes when the next one is written; the last one's stays
    until the caller calls ``release``.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = scratch.table(made, name.replace(" ", "-"))
        release(made)
    return docs
