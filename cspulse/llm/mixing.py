"""Mixing sources to target weights by order sampling in strata, in DataFrame operations only.

Targets.  A source's size is the words of its documents.  Sources weigh 5, 2, 1,
repeating, in code point order, and share all words by weight; a target stops
at ``max_copies`` times its source's size and the excess is shared again.

Copies.  With r = target / size of its source, every document is certain of
floor(r) whole copies; rest = r - floor(r) of the words are left to draw.  Each
document has its own inclusion probability

    p = rest + TILT min(rest, 1 - rest) (size - m) / m,

larger for longer documents: m is the word-weighted mean size of the
document's stratum (half an octave of sizes), so that the words drawn from a
stratum are still rest times its words on average, whatever the tilt.
Documents are ranked by Pareto's variable

    q = [u / (1 - u)] / [p / (1 - p)],    u a hash of the document in (0, 1),

and the n smallest of a stratum are taken: a sample of fixed size with unequal
probabilities.  The sizes n are fixed from the longest documents down, each
stratum making up for what rounding left before it, so the drawn words come
near the target.  Ranks come from one range sort of slim rows with counts by
partition, so a source that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Strata an octave of sizes.
STRATA = 2
#: How far a document's probability leans to its size; 2 keeps it between 0 and 1 in half an octave.
TILT = 2.0
_WORD = "[^\\x20\\x09-\\x0D]+"
_MASK = (1 << 33) - 1


def word_count(text_col: str = "text"):
    """Words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` sorted over the whole cluster, with ``at``: the row's partition and place in it.

    ``at`` grows along the order; its high bits are the partition, so ranks
    follow from row counts by partition, without one task for all rows.
    """
    return scratch.table(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()), name)


def source_weights(sources: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """Distinct ``source`` rows with ``weight``: the weights in turn by code point order, null last."""
    # Spark compares strings by their UTF-8 bytes, which is code point order.
    placed = positions(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"],
                       scratch, "sources").drop("_none")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(  # one row a partition of a range sort
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = placed.withColumn("part", F.shiftright("at", 33)).join(before, "part").withColumn(
        "rank", F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND(F.lit(_MASK)))
    pick = F.element_at(F.array(*map(F.lit, weights)),
                        (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.select(*sources.columns, pick.alias("weight"))


def targets(sources: DataFrame, max_copies: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: words shared by weight under the cap.

    Each round fixes every source above its cap and shares what is left among
    the others; two sums a round come to the driver.
    """
    cap = max_copies * F.col("source_size").cast("double")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    share = 0.0
    while True:
        over = share * F.col("weight") > cap if share else F.lit(False)
        fixed, free = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (total - (fixed or 0.0)) / free if free else 0.0
        if not free or new <= share:
            break
        share = new
    return sources.withColumn("target", F.least(cap, share * F.col("weight")))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken, weight.

    ``size`` counts words, ``taken`` is copies x size.  Null and empty texts
    have size 0 and are not copied; a null source is a source of its own.
    Repeated rows are drawn apart, in any order among themselves.  Reruns
    agree, as every draw is a hash of ``seed``, id and size.  No rows give no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    slim = scratch.table(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size")), "sizes")
    sizes = scratch.table(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    goals = scratch.table(
        targets(scratch.table(source_weights(sizes, weights, scratch), "weights"), max_copies),
        "targets")
    strata = scratch.table(_draws(slim, goals), "strata")

    # u in (0, 1) by id and size.
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = slim.withColumn("stratum", _stratum()).join(
        strata.withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("b")), "left").drop("s", "b")
    p = inclusion(F.col("rest"), F.col("size"), F.col("mean"))
    odds = F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))).otherwise(u / (1 - u))
    slim_drawn = drawn.select("id", "source", "size", "stratum", "source_size", "target", "whole",
                              "draw", "weight", odds.alias("q"))
    placed = positions(slim_drawn, ["source", "stratum", "q", "id", "size"], scratch, "order")

    part = F.shiftright("at", 33)
    runs = placed.groupBy("source", "stratum", part.alias("part")).agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("draw").alias("draw"))
    along = Window.partitionBy("source", "stratum").orderBy("part")
    cuts = scratch.table(
        runs.withColumn("left", F.col("draw") - F.coalesce(
            F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("source", "stratum")
        .agg(F.max(F.when(F.col("left") > 0, F.col("first") + F.least("left", "n") - 1)).alias("cut")),
        "cuts")
    scratch.keep(placed, cuts)
    result = placed.join(
        cuts.withColumnsRenamed({"source": "s", "stratum": "b"}),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("b")), "left")
    extra = F.coalesce((F.col("at") <= F.col("cut")).cast("long"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + extra).otherwise(F.lit(0))
    return result.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "weight")


def inclusion(rest, size, mean):
    """Probability of the one more copy: ``rest``, leaning to the longer documents of a stratum."""
    return rest + TILT * F.least(rest, 1 - rest) * (size - mean) / F.when(mean > 0, mean)


def _stratum():
    """Size class of a document: halves of an octave, -1 without words."""
    return F.when(F.col("size") > 0, F.floor(STRATA * F.log2(F.col("size").cast("double")))).otherwise(
        F.lit(-1)).cast("int")


def _draws(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source and stratum ``b``: its documents, certain copies and number to draw.

    A source has at most STRATA x 63 strata, handled in one row from the
    largest sizes down; a random start a stratum keeps the rounding fair.
    """
    strata = (slim.withColumn("b", _stratum()).groupBy("source", "b")
              .agg(F.count("*").alias("docs"), F.sum("size").alias("words"),
                   F.sum(F.col("size").cast("double") * F.col("size")).alias("squares")))
    by_source = strata.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct(
        "b", "docs", "words", (F.col("squares") / F.when(F.col("words") > 0, F.col("words"))).alias("mean"))))
    ).alias("strata"))
    goal = goals.withColumnRenamed("source", "s")
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0))
    rows = (by_source.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("whole", whole.cast("long"))
            .withColumn("rest", F.when(F.col("source_size") > 0, F.greatest(
                F.lit(0.0), F.col("target") / F.col("source_size") - F.col("whole"))).otherwise(F.lit(0.0))))
    # The number to draw from x: what is owed by now, rounded at random, but such that the strata
    # below x can still make up for the rounding.
    # A drawn document has so many words on average: its stratum's part over the sum of probabilities.
    chances = f"(rest * x.docs + {TILT} * least(rest, 1 - rest) * (x.words / x.mean - x.docs))"
    due, each = "(state.owed + rest * x.words)", f"if(rest > 0, rest * x.words / {chances}, x.words / x.docs)"
    below = "(state.below - x.words)"
    take = f"""CAST(CASE WHEN x.words = 0 THEN 0 ELSE greatest(0D, least(CAST(x.docs AS DOUBLE),
        greatest(ceil(({due} - (1 - rest) * {below}) / {each} - 1e-9),
          least(floor(({due} + rest * {below}) / {each} + 1e-9),
            floor({due} / {each} + (pmod(xxhash64('start', source, x.b), 1048576) + 0.5) / 1048576)))))
        END AS BIGINT)"""
    # State: words still owed, words of the strata from here on, and the strata so far with their draws.
    rows = rows.withColumn("done", F.expr(f"""
        aggregate(strata,
          named_struct('owed', CAST(0 AS DOUBLE), 'below', CAST(source_size AS DOUBLE),
                       'out', CAST(array() AS ARRAY<STRUCT<b: INT, mean: DOUBLE, draw: BIGINT>>)),
          (state, x) -> named_struct(
            'owed', IF(x.words = 0, state.owed, {due} - {take} * {each}), 'below', CAST({below} AS DOUBLE),
            'out', concat(state.out, array(named_struct('b', x.b, 'mean', x.mean, 'draw', {take})))))
    """))
    kept = ["source", "source_size", "target", "whole", "rest", "weight"]
    return rows.select(*kept, F.explode("done.out").alias("x")).select(*kept, "x.b", "x.mean", "x.draw")
