"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame operations only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's shingles (five words, space-joined; fewer words: the whole sequence).
Two sketches merge to the k smallest of both, so a text or corpus may be
sketched in parts.  From the k smallest of a union the share held by both
estimates resemblance, and the k-th smallest hash how many shingles there are;
below k shingles every figure is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .expressions import once
from .mixing import positions
from .storage import Scratch

SHINGLE = 5
K = 128
_SPACE = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array<long> of the k smallest distinct shingle hashes; null and wordless texts: empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")

    def shingles(hashes: Column) -> Column:
        """A shingle's hash is that of its words' hashes in order."""
        few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(
            F.array().cast("array<bigint>"))
        return F.when(F.size(hashes) < shingle, few).otherwise(F.transform(
            F.slice(hashes, 1, F.size(hashes) - (shingle - 1)),
            lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, shingle)))))

    return F.slice(F.array_sort(F.array_distinct(
        once(F.transform(words, lambda w: F.xxhash64(w)), shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched texts."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of both texts' shingles, 0 to 1; two empty sketches: 1."""
    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0)).cast("double")

    return once(merged(a, b, k), share)


def shingle_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (double); exact below k."""
    # Hashes are signed: the k-th smallest lies this share of 2^64 above the least long.
    share = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, 0 to 1; an empty a: 1."""
    shared = resemblance(a, b, k) * shingle_count(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / shingle_count(a, k))).otherwise(F.lit(1.0))


def merge_groups(rows: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch) with the union's sketch of each key, however many rows a key has.

    Hashes are deduplicated before the ranking, which Spark starts inside each
    map task, so a task holds k hashes of a key, not its rows.
    """
    hashes = rows.select(key, F.explode(sketch_col).alias("_h")).distinct()
    order = Window.partitionBy(key).orderBy("_h")
    least = hashes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    found = least.groupBy(key).agg(F.array_sort(F.collect_list("_h")).alias(sketch_col))
    keys = rows.select(key).distinct()
    return keys.join(found.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").select(
        key, F.coalesce(sketch_col, F.array().cast("array<bigint>")).alias(sketch_col))


def text_of(sketch_col: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, in order."""
    return F.concat_ws("", F.transform(sketch_col, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def followers(ids: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """``ids`` with next_<column> for each column of ``key``: the following row of the circle.

    Ascending order of doc_id, null first, then ``h``.  The neighbour inside a
    partition of the range sort is the row one place on; a partition's last row
    is followed by the next partition's first.
    """
    placed = positions(ids, ["doc_id", "h"], scratch, "by-id")
    ends = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"))
    ring = Window.orderBy("part")  # one row a partition of the range sort
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jumps = ends.select(F.col("last").alias("jump_from"), F.coalesce(
        F.lead("first").over(ring), F.min("first").over(whole)).alias("jump_to"))
    after = placed.join(F.broadcast(jumps), placed.at == F.col("jump_from"), "left").withColumn(
        "next_at", F.coalesce("jump_to", F.col("at") + 1)).drop("at", "jump_from", "jump_to")
    names = placed.select(F.col("at").alias("next_at"), *(F.col(c).alias(f"next_{c}") for c in key))
    return after.join(names, "next_at").drop("next_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        k: int = K) -> DataFrame:
    """Every row's sketch, that of its edited text and their likenesses.

    The edited text has its last floor(n/4) code points replaced by as many
    first ones of the next document's text (or all of it) in ascending id
    order, the last followed by the first.  Null ids come first; different
    texts of one id follow each other in a fixed order; repeated rows (same id
    and text) are one document in that order, and each is returned.  A single
    document follows itself.  Null texts are empty.  No rows give no rows;
    other columns are not read.  Columns: id, n_chars, edited (text), sketch,
    edited_sketch, next_sketch, near_edited, near_next, contained, shingles.

    The texts are shuffled once, by id: both joins read the same exchange.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Plain equalities on these name a document, null id or not, and need one exchange.
    rows = rows.withColumns({"id0": F.coalesce("doc_id", F.lit(0).cast(rows.schema["doc_id"].dataType)),
                             "none": F.col("doc_id").isNull(), "h": F.xxhash64("text")})
    key = ["id0", "none", "h"]
    ids = rows.select("doc_id", *key, F.length("text").cast("long").alias("n_chars")).distinct()
    pairs = scratch.table(followers(ids, key, scratch).drop("doc_id"), "pairs")
    scratch.keep(pairs)
    # The next document's part: its start and its sketch, once for repeated rows.
    texts = rows.select(*key, "text")
    nxt = texts.join(
        pairs.withColumnsRenamed({c: f"own_{c}" for c in key} | {f"next_{c}": c for c in key}), key)
    nxt = nxt.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("own_h")))
    nxt = nxt.where("_n = 1").select(
        *(F.col(f"own_{c}").alias(c) for c in key), "n_chars",
        F.expr("substring(text, 1, CAST(n_chars DIV 4 AS INT))").alias("start"),
        sketch(F.col("text"), k).alias("next_sketch"))
    own = texts.join(nxt, key)
    edited = own.select(
        F.when(~F.col("none"), F.col("id0")).alias(id_col), "n_chars",
        F.expr("concat(substring(text, 1, CAST(n_chars - n_chars DIV 4 AS INT)), start)").alias("edited"),
        sketch(F.col("text"), k).alias("sketch"), "next_sketch")
    both = edited.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return both.withColumns({
        "near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k),
        "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k),
        "contained": containment(F.col("edited_sketch"), F.col("sketch"), k),
        "shingles": shingle_count(F.col("sketch"), k)})
