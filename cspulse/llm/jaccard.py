"""Set-similarity join of word n-grams by vertical partitioning.

A document is the set of its shingles (five words), and two documents link
when their sets' Jaccard similarity is at least PERCENT per cent.

1. Screen.  Documents of one set are one class.  By hash order, similar sets
   share a part of their first shingles: where s and r are similar at most D(s)
   shingles of s are not in r, so of the first D(s) + x at least x are, and both
   sets' heads hold the same first common shingles.  A class of whose head too
   few shingles occur in other classes has no partner and is left out.
2. Global order.  The rest's shingles are ordered by document frequency, rare
   ones first, and the order is cut at its quantiles into FRAGMENTS: every set
   falls into one segment a fragment.
3. Candidates share a shingle among the first D + 1 of both sets (those before
   are in no other set) and pass three bounds that no similar pair exceeds: on
   the lengths, on the shingle's positions, and on the bits in which bitmaps of
   the two sets differ.
4. Each fragment counts a pair's overlap in its own segments alone; the sum of
   the partial counts decides the pair.

Only components are asked for, so not every pair of a large group is counted.
First each class meets one leader of its shingles, in rounds that join what
links; then every candidate pair whose ends have not been joined is counted, so
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch, importable_in_workers

SHINGLE = 5
PERCENT = 80
FRAGMENTS = 8
#: Shingles of a head beyond those that a partner may lack, in per cent of the set.
EXTRA = 10
#: Leader rounds before the remaining pairs are counted.
ROUNDS = 1
#: Longs of a set's signature.
WORDS = 16
#: Words of the bitmap that keeps other texts from being sorted; at most 16 bytes each are broadcast.
BITMAP_WORDS = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a whole text's distinct shingles; fewer words are one shingle, none none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for at in range(width):
        out = _mixed(out * _STEP + hashes[at: at + len(out)])
    return np.unique(out.view(np.int64))


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the shingles in WORDS longs: a bit that one of two sets has alone stands for a shingle of that kind."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[np.asarray(tokens, np.int64) % (64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of ``n`` that a similar set has at least."""
    return -(-n * percent // 100)


def _witnesses(percent: int):
    """Heads of one batch: shared shingles are counted here, the others sent on.

    Rows (h, who, times, need).  times 0: ``who`` has shingle h; -1: classes of
    this batch share h, sent once however many they are; else so many shingles
    of ``who`` are shared already, and ``need`` in all keep it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            whole = whole.drop_duplicates("key")
            cuts = np.cumsum(whole["head"].map(len).to_numpy()) // (1 << 23)
            for _, batch in whole.groupby(cuts):
                keys = batch["key"].to_numpy(np.int64)
                n = batch["n"].to_numpy(np.int64)
                heads = [np.frombuffer(h, np.int64) for h in batch["head"]]
                h = np.concatenate(heads)
                own = np.repeat(np.arange(len(keys)), [len(x) for x in heads])
                order = np.argsort(h, kind="stable")
                h, own = h[order], own[order]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                many = np.repeat(np.diff(np.r_[starts, len(h)]) > 1, np.diff(np.r_[starts, len(h)]))
                alone = ~many
                yield pd.DataFrame({"h": h[alone], "who": keys[own[alone]], "times": 0, "need": 0})
                yield pd.DataFrame({"h": h[starts][many[starts]], "who": 0, "times": -1, "need": 0})
                yield pd.DataFrame({
                    "h": _mixed(keys.view(np.uint64)).view(np.int64), "who": keys,
                    "times": np.bincount(own[many], minlength=len(keys)),
                    "need": -(-_least(n, percent) * EXTRA // 100)}).query("need > 0")

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(who, times, need) from rows sorted by shingle: how many of a class's shingles others have.

    A shingle has at most one row a batch of documents and class alone, or one
    witness a batch, so the rows held over are few.
    """

    def counted(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        told = rows["times"].to_numpy() > 0
        kept = rows[rows["need"].to_numpy() > 0]
        yield kept[["who", "times", "need"]]
        rows = rows[~told & (rows["need"].to_numpy() == 0)]
        h, who, times = (rows[c].to_numpy() for c in ("h", "who", "times"))
        if not len(h):
            return
        first = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | (times[1:] != times[:-1])]
        h, who, times = h[first], who[first], times[first]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        # A witness stands for two classes at least.
        classes = np.add.reduceat(np.where(times < 0, 2, 1), starts)
        hit = np.repeat(classes > 1, sizes) & (times == 0)
        found, n = np.unique(who[hit], return_counts=True)
        yield pd.DataFrame({"who": found, "times": n, "need": 0})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows["h"].to_numpy() == rows["h"].to_numpy()[-1:] if len(rows) else np.empty(0, bool)
        held = rows[last]
        yield from counted(rows[~last])
    if held is not None and len(held):
        yield from counted(held)


def screened(prints: DataFrame, percent: int) -> DataFrame:
    """Keys of the classes that may have a partner, from (key, n, head)."""
    rows = prints.where("n > 0").select("key", "n", "head").mapInPandas(
        _witnesses(percent), "h long, who long, times int, need int")
    counts = rows.repartition("h").sortWithinPartitions("h", "who", "times").mapInPandas(
        _shared, "who long, times int, need int")
    return (counts.groupBy("who").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
            .where("times >= need").selectExpr("who AS key"))


def in_bitmap(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` but most of those whose ``column`` (a hash) is not in ``wanted``; none that is.

    The bitmap has at most BITMAP_WORDS rows whatever the size of ``wanted``.
    """
    word, bit = F.pmod(column, F.lit(BITMAP_WORDS)), F.shiftrightunsigned(column, 40).bitwiseAND(63).cast("int")
    bits = (wanted.withColumns({"_word": word, "_bit": bit}).groupBy("_word")
            .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask")))
    return (rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
            .where("shiftrightunsigned(_mask, _bit) & 1 = 1").drop("_word", "_bit", "_mask"))


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, ord): the shingles that other sets have, in the global order, of sets with enough of them.

    ``ord`` holds (g, h); g has the document frequency and the hash's upper half.
    """
    rows = sets.selectExpr("key", "n", "explode(tokens) AS h")
    df = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    named = rows.join(df, "h").selectExpr(
        "key", "n", "h", "shiftleft(least(df, 1073741824L), 32) | shiftrightunsigned(h, 32) AS g")
    return (named.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("g", "h"))).alias("ord"))
            .where(F.size("ord") * 100 >= F.col("n") * percent))


def segmented(orders: DataFrame, fragments: int) -> DataFrame:
    """(key, fragment, part): each set's shingles by fragment of the global order."""
    cuts = orders.selectExpr("explode(ord.g) AS g").agg(F.percentile_approx(
        "g", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("array<struct<fragment: int, part: array<bigint>>>")
    def cut(g: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for order, tokens in zip(g, h, strict=True):
            at = np.r_[0, np.searchsorted(order, cuts, "right"), len(order)]
            out.append([{"fragment": i, "part": tokens[a:b]}
                        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a])
        return pd.Series(out)

    return orders.select("key", F.explode(cut("ord.g", "ord.h")).alias("s")).select("key", "s.fragment", "s.part")


def similar(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps of each fragment, summed by pair."""
    first = pairs.join(segments.selectExpr("key AS a", "fragment", "part AS pa"), "a")
    both = first.join(segments.selectExpr("key AS b", "fragment", "part AS pb"), ["b", "fragment"])
    partial = both.selectExpr("a", "b", "na", "nb", "size(array_intersect(pa, pb)) AS o")
    return (partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
            .where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b"))


def _apart() -> str:
    """At least so many shingles are in one only of the sets a and b (signatures sa and sb, own shingles oa and ob)."""
    return "(oa + ob + " + " + ".join(f"bit_count(sa[{i}] ^ sb[{i}])" for i in range(WORDS)) + ")"


def _possible(percent: int) -> str:
    """Bounds on a pair that shares the shingle at positions pa and pb of sets of na and nb."""
    return (f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * "
            f"(least(pa, pb) + 1 + least(na - pa, nb - pb) - 1) >= {percent} * (na + nb) AND "
            f"{100 + percent} * {_apart()} <= {100 - percent} * (na + nb)")


_A = ["key AS ka", "n AS na", "pos AS pa", "own AS oa", "sig AS sa", "c AS ca"]


def _leaders(post: DataFrame, turn: int, percent: int) -> DataFrame:
    """One candidate pair for each class that shares a shingle with another component: with the nearest leader.

    The leader of a shingle, among sets of about one size, is in turn 0 the set
    whose shingles are the most frequent (the middle of a group of copies),
    later one that a hash of shingle and turn draws.  Of its shingles' leaders
    a class takes the one whose signature differs least.
    """
    p = post.withColumns({"band": F.expr("CAST(floor(ln(n) / ln(1.25D)) AS INT)"),
                          "rank": F.expr("-weight" if turn == 0 else f"CAST(xxhash64(key, h, {turn}) AS DOUBLE)")})
    lead = p.groupBy("h", "band").agg(
        F.min(F.struct("rank", "key", "n", "pos", "own", "sig", "c")).alias("l"), F.min("c").alias("low"),
        F.max("c").alias("high")).where("low < high").select("h", "band", "l")
    met = p.join(lead, ["h", "band"]).where("c <> l.c").selectExpr(
        *_A, "l.key AS kb", "l.n AS nb", "l.pos AS pb", "l.own AS ob", "l.sig AS sb").where(_possible(percent))
    best = met.groupBy("ka", "na").agg(F.min(F.struct(F.expr(_apart()).alias("far"), "kb", "nb")).alias("l")).selectExpr(
        "ka", "na", "l.kb AS kb", "l.nb AS nb")
    return _pairs(best)


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb), a below b, of (ka, kb, na, nb)."""
    return met.selectExpr("least(ka, kb) AS a", "greatest(ka, kb) AS b", "if(ka < kb, na, nb) AS na",
                          "if(ka < kb, nb, na) AS nb").distinct()


def _rest(post: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair whose ends are in different components, once."""
    sizes = post.groupBy("h", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"),
                                  F.count("*").alias("parts")).where("parts > 1").select("h", "main")
    mixed = post.join(main, "h")
    # One end at least is outside a shingle's largest component.
    out = mixed.where("c <> main").selectExpr("h", *_A)
    return _pairs(out.join(mixed.selectExpr(
        "h", "key AS kb", "n AS nb", "pos AS pb", "own AS ob", "sig AS sb", "c AS cb"), "h").where(
        f"ca <> cb AND {_possible(percent)}"))


def _relabelled(classes: DataFrame, links: DataFrame, passes: int = 3) -> DataFrame:
    """(key, c) after some passes in which each class takes the least label of those it links to.

    Classes of one label are in one component; the reverse may need more passes.
    """
    both = links.selectExpr("a AS key", "b AS other").unionAll(links.selectExpr("b AS key", "a AS other"))
    for _ in range(passes):
        told = both.join(classes.selectExpr("key AS other", "c AS d"), "other").groupBy("key").agg(F.min("d").alias("d"))
        classes = classes.join(told, "key", "left").selectExpr("key", "least(c, d) AS c")
    return classes


def class_links(prints: DataFrame, keys: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int,
                percent: int, fragments: int, rounds: int) -> DataFrame:
    """(node, component) of every class of ``keys`` that links to another."""

    @F.pandas_udf("array<bigint>")
    def tokens(part: pd.Series) -> pd.Series:
        return part.map(lambda t: shingle_set(t, shingle))

    @F.pandas_udf("array<bigint>")
    def signed(part: pd.Series) -> pd.Series:
        return part.map(signature)

    same = ["id0", "none", "t"]
    chosen = scratch.table(
        prints.join(keys, "key", "left_semi").groupBy("key", "n")
        .agg(F.min(F.struct("none", "id0", "t")).alias("r")).select("key", "n", "r.*"), "chosen", gather=True)
    found = in_bitmap(texts, chosen, "t").dropDuplicates(same).join(chosen, same)
    sets = scratch.table(found.select("key", "n", tokens("text").alias("tokens")), "sets")
    orders = scratch.table(ordered(sets, percent), "orders")
    scratch.drop(sets)
    segments = scratch.table(segmented(orders, fragments), "segments")
    # The first D + 1 shingles; the n - size(ord) before these are in no other set.
    rows = orders.withColumn("own", F.expr("CAST(n - size(ord) AS INT)"))
    classes = scratch.table(rows.select(
        "key", "n", "own", signed("ord.h").alias("sig"),
        F.expr("aggregate(ord, 0D, (w, o) -> w + ln(shiftright(o.g, 32))) / n").alias("weight")), "classes", gather=True)
    post = scratch.table(rows.selectExpr(
        "key", f"posexplode(slice(ord, 1, CAST(n - ceil(n * {percent} / 100) + 1 AS INT) - own)) AS (at, o)", "own")
        .selectExpr("key", "o.h AS h", "own + at AS pos"), "post", gather=True)
    scratch.drop(orders)

    labels = scratch.table(classes.selectExpr("key", "key AS c"), "labels", gather=True)
    links = checked = None
    for turn in range(rounds + 1):
        placed = post.join(classes.join(labels, "key"), "key")
        pairs = _rest(placed, percent) if turn == rounds else _leaders(placed, turn, percent)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, "pairs", gather=True)
        good = scratch.table(similar(pairs, segments, percent), "links", gather=True)
        links = good if links is None else links.unionAll(good)
        checked = pairs if checked is None else checked.unionAll(pairs)
        if turn < rounds:
            labels = scratch.table(_relabelled(labels, links), "labels", gather=True)
    # Labels shorten the paths; ends of one label are in one component.
    return components(links.unionAll(labels.where("key <> c").selectExpr("key AS a", "c AS b")), scratch,
                      gather=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS,
                       rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at least
    ``percent`` per cent Jaccard similarity, the row itself included.  A null,
    empty or wordless text has no shingles and links to nothing.  Equal sets are
    similar; repeated rows and ids stay; rows without id take part, and their
    component's id is null if no member has one.  Texts are read whole.  No rows
    give no rows; other columns, of any name, are not read.  Shingles and sets
    are told apart by 64-bit hashes: at 10^8 documents the odds that two
    different sets are taken for one are about 3 in 10,000.
    """
    spark = docs.sparkSession
    importable_in_workers(spark)
    scratch = Scratch(spark, "jaccard")

    @F.pandas_udf("key long, n long, head binary")
    def sketched(part: pd.Series) -> pd.DataFrame:
        out = []
        for text in part:
            tokens = shingle_set(text, shingle)
            n = len(tokens)
            lack = n - int(_least(np.int64(n), percent))
            key = int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).astype(np.int64)) if n else None
            out.append((key, n, tokens[: lack + -(-n * EXTRA // 100)].tobytes()))
        frame = pd.DataFrame(out, columns=["key", "n", "head"])
        return frame.assign(key=frame["key"].astype("Int64"))

    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id0"), F.col(text_col).alias("text"))
    texts = texts.select(F.coalesce("id0", F.lit(0).cast(kind)).alias("id0"), F.col("id0").isNull().alias("none"),
                         F.xxhash64("text").alias("t"), "text")
    full = scratch.table(texts.withColumn("s", sketched("text")).select("id0", "none", "t", "s.*"), "heads")
    keys = scratch.table(screened(full, percent), "screened", gather=True)
    prints = scratch.table(full.drop("head"), "prints", gather=True)
    scratch.drop(full)
    labels = class_links(prints, keys, texts, scratch, shingle, percent, fragments, rounds)
    rows = prints.select(F.when(~F.col("none"), F.col("id0")).alias("id"), "key", "n")
    low = scratch.table(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("low")), "classes", gather=True)
    member = scratch.table(low.join(labels, low.key == labels.node, "left").select(
        "key", "low", F.coalesce("component", "key").alias("component")), "members", gather=True)
    lowest = scratch.table(member.groupBy("component").agg(F.min("low").alias("component_id")), "lowest", gather=True)
    named = scratch.table(member.join(lowest, "component").select("key", "component_id"), "named", gather=True)
    scratch.keep(prints, named)
    return rows.join(named, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
