"""Ranked lexical search by pipelined term partitioning.

The index is cut by term: each term has an owner, one of STAGES that stand in a
row, the rarest terms first.  An item's bundle passes every owner in turn; it
carries the accumulators gathered so far, sparse (document, score) pairs, and
each owner cogroups it with its posting lists and adds their integer
contributions.  The last owner, of the most frequent terms, hands on each
bundle's best documents alone, so that accumulators for documents that share
only frequent words with an item are never sent.

Owners work in parallel on blocks of at most BLOCK_DOCS documents and groups of
about GROUP_ITEMS items: a bundle is split by block, as the posting lists are,
so no task holds a term's whole list or an item's whole accumulator.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch, importable_in_workers

BLOCK_DOCS = 4096
#: A block also ends with so many postings.
BLOCK_POSTINGS = 1_000_000
GROUP_ITEMS = 256
#: Owners by a term's share of the documents: below the first bound, below the next, and so on.
SHARES = (0.001, 0.01, 0.1)
STAGES = len(SHARES) + 1
#: Tasks that read the texts get the items' terms up to this size; beyond it they index every term.
#: Tasks that read the index get the terms' weights and items up to this size; beyond it they are joined by term.
VOCABULARY_BYTES = 8 << 20

# UTF-8 bytes: digits, letters and all of non-ASCII belong to terms, A-Z lower-cased.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))

_INDEX = "block long, term string, docs binary, tfs binary, ids array<long>, ns array<long>"
_BUNDLE = "block long, items int, item long, docs binary, scores binary"


def terms(text: str) -> list[bytes]:
    """Terms of a text in order: runs of letters, digits and non-ASCII, only A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def _indexer(vocabulary, block_docs: int):
    """Blocks of documents as posting lists, with a row (term null) of their ids and lengths.

    ``vocabulary``: a broadcast set of the terms to keep, None for all.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        wanted = vocabulary.value if vocabulary else None
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[bool, int, int, list]] = []
        size = 0

        def rows() -> pd.DataFrame:
            held.sort(key=lambda d: d[:2])  # by id, null last: place in the block decides ties
            lists: dict[bytes, tuple[list, list]] = {}
            for at, (_, _, _, counts) in enumerate(held):
                for term, tf in counts:
                    docs, tfs = lists.setdefault(term, ([], []))
                    docs.append(at)
                    tfs.append(tf)
            head = (block, None, None, None, [None if d[0] else d[1] for d in held], [d[2] for d in held])
            return pd.DataFrame(
                [head, *((block, term.decode(), np.array(docs, np.uint16).tobytes(),
                          np.array(tfs, np.int32).tobytes(), None, None)
                         for term, (docs, tfs) in lists.items())],
                columns=["block", "term", "docs", "tfs", "ids", "ns"])

        for batch in batches:
            for none, name, text in zip(batch["none"], batch["id"], batch["text"], strict=True):
                found = terms(text or "")
                counts = Counter(found if wanted is None else [t for t in found if t in wanted])
                held.append((bool(none), int(name), len(found), list(counts.items())))
                size += len(counts)
                if len(held) >= block_docs or size >= BLOCK_POSTINGS:
                    yield rows()
                    held, size, block = [], 0, block + 1
        if held:
            yield rows()

    return index


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(item, t.decode()) for item, text in zip(batch["item"], batch["text"], strict=True)
               for t in dict.fromkeys(terms(text or ""))]
        yield pd.DataFrame(out, columns=["item", "term"])


def _adder(documents: int, total: int, keep: int | None):
    """An owner's work on one block: bundles in, contributions added, bundles out.

    The last owner (``keep`` given) returns the best ``keep`` documents of each bundle instead.
    """

    def add(bundles: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        heads = owned["ns"].notna()
        head = owned[heads].iloc[0]
        n = np.asarray(head["ns"], np.int64)
        m = 100 - 50 + (50 * n * documents) // total
        scores: dict[int, np.ndarray] = {}

        def of(item: int) -> np.ndarray:
            if item not in scores:
                scores[item] = np.zeros(len(n), np.int64)
            return scores[item]

        for item, docs, gained in zip(bundles["item"], bundles["docs"], bundles["scores"], strict=True):
            of(item)[np.frombuffer(docs, np.uint16)] = np.frombuffer(gained, np.int64)
        lists = owned[~heads]
        for weight, wanting, docs, tfs in zip(lists["w"], lists["wanting"], lists["docs"], lists["tfs"],
                                              strict=True):
            at = np.frombuffer(docs, np.uint16)
            tf = np.frombuffer(tfs, np.int32).astype(np.int64)
            gain = int(weight) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
            for item in wanting:
                of(item)[at] += gain
        out = []
        for item, score in scores.items():
            at = np.flatnonzero(score)
            if keep is None:
                out.append((head["block"], head["items"], item, at.astype(np.uint16).tobytes(),
                            score[at].tobytes()))
            else:
                best = at[np.lexsort((at, -score[at]))[:keep]]
                out.append((item, [head["ids"][i] for i in best], score[best]))
        if keep is None:
            return pd.DataFrame(out, columns=["block", "items", "item", "docs", "scores"])
        return pd.DataFrame(out, columns=["item", "ids", "scores"])

    return add


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS,
           group_items: int = GROUP_ITEMS, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(item, rank, document, score): the ``k`` best documents of every item with a score above 0.

    Columns ``item_col``, rank (int, from 1), ``id_col`` and score (long).
    Equal scores come by ascending id, null last; rows of one id and score are
    alike.  Null, empty and termless texts and items match nothing; texts are
    read whole.  Repeated documents are documents of their own; a repeated item
    (same id and text) is one item, two texts of one id are two with their own
    ranks.  No documents or no items give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    importable_in_workers(spark)
    scratch = Scratch(spark, "lexical")
    queries = items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")).distinct()
    queries = scratch.table(queries.withColumn("item", F.xxhash64("name", "text")), "items", gather=True)
    asked = scratch.table(queries.mapInPandas(_item_terms, "item long, term string").distinct(), "asked", gather=True)
    groups = max(1, -(-queries.count() // group_items))
    sizes = asked.groupBy("term").agg(F.count("*").alias("n")).selectExpr("n", "octet_length(term) + 64 AS b").agg(
        F.sum("b").alias("terms"), F.sum(F.expr(f"b * least(n, {groups}) + 8 * n")).alias("wanting")).first()
    vocabulary = None
    if (sizes.terms or 0) <= vocabulary_bytes:
        vocabulary = spark.sparkContext.broadcast(
            frozenset(r.term.encode() for r in asked.select("term").distinct().collect()))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                       F.col(id_col).isNull().alias("none"), F.col(text_col).alias("text"))
    index = scratch.table(rows.mapInPandas(_indexer(vocabulary, block_docs), _INDEX), "index")
    heads, lists = index.where("term IS NULL"), index.where("term IS NOT NULL")
    counts = heads.selectExpr("size(filter(ns, n -> n > 0)) AS some",
                              "aggregate(ns, 0L, (a, n) -> a + n) AS many").agg(
        F.sum("some").alias("documents"), F.sum("many").alias("total")).first()
    documents, total = counts.documents or 0, counts.total or 0

    # Each term's weight and owner, and the items of each group that ask for it.
    df = lists.groupBy("term").agg(F.sum(F.expr("octet_length(docs) DIV 2")).alias("df"))
    owner = " + ".join(f"CAST(df >= {s}D * {documents} AS INT)" for s in SHARES)
    wanting = (asked.join(df, "term").groupBy("term", "df", F.expr(f"CAST(pmod(item, {groups}) AS INT)").alias("items"))
               .agg(F.collect_list("item").alias("wanting")).selectExpr(
        "term", "items", "wanting", f"{owner} AS owner",
        f"CAST(floor(1000 * ln(CAST({2 * documents + 2} AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w"))
    columns = ["block", "items", "owner", "w", "wanting", "docs", "tfs"]
    if (sizes.wanting or 0) <= vocabulary_bytes:
        # Each owner picks its lists from the index itself: no list is shuffled by term or written again.
        wanting = scratch.table(wanting, "wanting", gather=True)
        postings = lists.join(F.broadcast(wanting), "term").select(columns)
        scratch.keep(queries, index, wanting)
    else:
        postings = scratch.table(lists.join(wanting, "term").select(columns), "postings")
        scratch.keep(queries, index, postings)
    heads = heads.selectExpr("block", f"explode(sequence(0, {groups - 1})) AS items", "ids", "ns")

    bundles = spark.createDataFrame([], _BUNDLE)
    for stage in range(STAGES):
        owned = postings.where(F.col("owner") == stage).drop("owner").unionByName(
            heads, allowMissingColumns=True)
        last = stage == STAGES - 1
        bundles = bundles.groupBy("block", "items").cogroup(owned.groupBy("block", "items")).applyInPandas(
            _adder(documents, max(total, 1), k if last else None),
            "item long, ids array<long>, scores array<long>" if last else _BUNDLE)
    best = bundles.selectExpr("item", "explode(arrays_zip(ids, scores)) AS d").selectExpr(
        "item", "d.ids AS id", "d.scores AS score")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "score")
