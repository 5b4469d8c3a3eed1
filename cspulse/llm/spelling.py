"""Spelling variants: words one edit apart, found with a trie of letter counts.

Letters fall into LEVELS groups (the most frequent letters alone, the others
dealt over the last groups) and a word becomes the vector of its group counts.
Level i of the trie branches on the count of group i; words with one vector
share a leaf.  One inserted, deleted or replaced letter adds at most one to one
count and takes at most one from one, so a depth-first search spends a surplus
and a deficit of one each, and the words of the leaves it reaches are verified
letter by letter.

The top levels of the trie are its shards: a word lives in the shard of its
first counts and visits each shard above its own that the budgets reach, with
what they leave.  The number of top levels is the least that keeps every shard
under SHARD_WORDS; a shard beyond that at full depth is cut into blocks, each
visited by the words of the blocks before it.  A shard task returns one row a
word, never its pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, importable_in_workers

#: Letter groups, and of those the letters with a group of their own.
LEVELS, ALONE = 16, 10
#: Most words that live in one shard (or block of one).
SHARD_WORDS = 20_000
#: Trie nodes of so few words are searched word by word.
LEAF_WORDS = 4
_FLUSH = 400_000
_PAIRS = 1 << 20
_WIDTH = 48

# Latin-1 byte of each letter of a run, A-Z lower-cased; anything else ends a run.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, as Latin-1 bytes."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def spoilt(run: bytes, start: int, every: int) -> bytes:
    """``run`` without one letter where ``every`` divides the crc32 of its id, a colon and its UTF-8.

    ``start`` is the crc32 of the id and the colon.
    """
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counter(every: int | None, min_chars: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in total],
                                 "n": np.fromiter(total.values(), np.int64, len(total))})

        for batch in batches:
            for name, text in zip(batch["id"], batch["text"], strict=True):
                if text is None:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(r for r in runs(text) if len(r) >= min_chars).items():
                    word = spoilt(run, start, every) if every else run
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) > _FLUSH:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                typo_every: int | None = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words with ``min_chars`` letters or more and ``min_count`` occurrences or more.

    Each task counts before the shuffle.  ``typo_every`` deletes one letter of
    the runs whose hash it divides (see ``spoilt``), None deletes none.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInPandas(_counter(typo_every, min_chars), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each Latin-1 byte, by how often the letters occur in ``words``.

    At most one row a letter of the alphabet reaches the driver.
    """
    counts = (words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
              .groupBy("letter").count().collect())
    groups = np.zeros(256, np.int64)
    for at, row in enumerate(sorted(counts, key=lambda r: (-r["count"], r.letter))):
        groups[ord(row.letter)] = at if at < ALONE else ALONE + (at - ALONE) % (LEVELS - ALONE)
    return groups


def _matrix(words: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Group counts of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = groups[np.frombuffer(b"".join(words), np.uint8)]
    at = np.repeat(np.arange(len(words)), lengths) * LEVELS + letters
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def _prefix(counts) -> str:
    return ".".join(map(str, counts))


def _reachable(top: list[int]) -> Iterator[tuple[list[int], int, int]]:
    """(counts, surplus left, deficit left) of every shard above ``top`` within the budgets."""
    depth = len(top)
    for i in range(depth):
        up = [*top[:i], top[i] + 1, *top[i + 1:]]
        yield up, 0, 1
        for j in range(depth):
            if j != i and top[j]:
                both = [*up[:j], up[j] - 1, *up[j + 1:]]
                if both > top:
                    yield both, 0, 0


def _placer(groups: np.ndarray, depth: int, visiting: bool):
    """Rows (shard, word, n, surplus, deficit): where each word lives, or which shards it visits."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, list] = {}
        for batch in batches:
            top = _matrix([w.encode("latin-1") for w in batch["word"]], groups)[:, :depth].tolist()
            if not visiting:
                yield pd.DataFrame({"shard": [_prefix(t) for t in top], "word": batch["word"],
                                    "n": batch["n"]})
                continue
            for low in range(0, len(top), 5000):
                out = []
                for t, word, n in zip(top[low: low + 5000], batch["word"][low: low + 5000],
                                      batch["n"][low: low + 5000], strict=True):
                    at = tuple(t)
                    if at not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[at] = [(_prefix(p), s, d) for p, s, d in _reachable(t)]
                    out += [(p, word, n, s, d) for p, s, d in known[at]]
                if out:
                    yield pd.DataFrame(out, columns=["shard", "word", "n", "surplus", "deficit"])

    return place


def _aligned(words: list[bytes], width: int, right: bool) -> np.ndarray:
    """Letters of each word in ``width`` columns, from the left or the right."""
    pad = bytes.rjust if right else bytes.ljust
    cut = [w[-width:] if right else w[:width] for w in words]
    return np.frombuffer(b"".join(pad(w, width, b"\0") for w in cut), np.uint8).reshape(-1, width)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class _Pairs:
    """Verifies candidate pairs and keeps each word's number of near words and the best of them."""

    def __init__(self, words: list[bytes], n: np.ndarray) -> None:
        self.words, self.n = words, n
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(min(_WIDTH, self.length.max(initial=1)))
        self.left, self.right = (_aligned(words, self.width, side) for side in (False, True))
        # Words by count, largest first, then in code-point order (that of the bytes): the best is lowest.
        order = np.lexsort((np.unique(np.array(words, object), return_inverse=True)[1], -n))
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))
        self.order = order
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size >= _PAIRS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        most = np.maximum(self.length[a], self.length[b])
        keep = np.abs(self.length[a] - self.length[b]) <= 1
        a, b, most = a[keep], b[keep], most[keep]
        long = most > self.width
        for low in range(0, len(a), 1 << 17):
            x, y = a[low: low + (1 << 17)], b[low: low + (1 << 17)]
            shared = np.zeros(len(x), np.int64)
            for side, step in ((self.left, 1), (self.right, -1)):
                same = (side[x] == side[y])[:, ::step]
                shared += np.where(same.all(axis=1), self.width, same.argmin(axis=1))
            good = shared >= most[low: low + (1 << 17)] - 1
            for at in np.flatnonzero(long[low: low + (1 << 17)]):
                good[at] = one_edit(self.words[x[at]], self.words[y[at]])
            for p, q in ((x[good], y[good]), (y[good], x[good])):
                self.near += np.bincount(p, minlength=len(self.near))
                np.minimum.at(self.best, p, self.place[q])


def search(vectors: np.ndarray, lives: np.ndarray, visits: np.ndarray, surplus: np.ndarray,
           deficit: np.ndarray, found) -> None:
    """Depth-first search of the trie of rows ``lives`` for all rows ``visits`` at once.

    ``vectors`` are the remaining levels of each row.  The budgets are those of
    each visit.  ``found(visits, lives)`` gets the rows that meet in a leaf.
    """
    if vectors.shape[1]:
        lives = lives[np.lexsort(vectors[lives].T[::-1])]
    table = vectors[lives]
    levels = table.shape[1]
    stack = [(0, 0, len(lives), visits, surplus, deficit)] if len(lives) else []
    while stack:
        level, low, high, who, up, down = stack.pop()
        while high - low > LEAF_WORDS and level < levels:
            column = table[low:high, level]
            if column[0] == column[-1]:  # one child: go down without a new node
                step = column[0] - vectors[who, level]
                keep = (step <= up) & (step >= -down)
                who, up, down, step = who[keep], up[keep], down[keep], step[keep]
                up, down = up - np.maximum(step, 0), down + np.minimum(step, 0)
                level += 1
                if not len(who):
                    break
                continue
            cuts = np.r_[0, np.flatnonzero(column[1:] != column[:-1]) + 1, high - low]
            own = vectors[who, level]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                step = column[a] - own
                keep = (step <= up) & (step >= -down)
                if keep.any():
                    step = step[keep]
                    stack.append((level + 1, low + a, low + b, who[keep],
                                  up[keep] - np.maximum(step, 0), down[keep] + np.minimum(step, 0)))
            who = who[:0]
            break
        if len(who):
            leaf = lives[low:high]
            found(np.repeat(who, len(leaf)), np.tile(leaf, len(who)))


def _searcher(groups: np.ndarray, depth: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["word", "surplus"]).reset_index(drop=True)
        words = [w.encode("latin-1") for w in rows["word"]]
        home = (rows["surplus"] < 0).to_numpy()
        vectors = _matrix(words, groups)[:, depth:]
        pairs = _Pairs(words, rows["n"].to_numpy(np.int64))
        lives = np.flatnonzero(home)

        def meet(a: np.ndarray, b: np.ndarray) -> None:
            once = ~home[a] | (a < b)  # words that live here meet each other once
            pairs.add(a[once], b[once])

        full = np.where(home, 1, rows["surplus"].to_numpy(np.int64))
        spare = np.where(home, 1, rows["deficit"].to_numpy(np.int64))
        for low in range(0, len(rows), 1 << 15):
            who = np.arange(low, min(low + (1 << 15), len(rows)))
            search(vectors, lives, who, full[who], spare[who], meet)
        pairs.flush()
        hit = np.flatnonzero(pairs.near)
        best = pairs.order[pairs.best[hit]]
        return pd.DataFrame({"word": rows["word"].to_numpy()[hit], "near": pairs.near[hit],
                             "best_n": pairs.n[best], "best": rows["word"].to_numpy()[best]})

    return run


def _depth(words: DataFrame, groups: np.ndarray, shard_words: int) -> int:
    """Fewest top levels with at most ``shard_words`` words a shard."""
    for depth in range(3, LEVELS):
        homes = words.mapInPandas(_placer(groups, depth, False), "shard string, word string, n long")
        if (homes.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) <= shard_words:
            return depth
    return LEVELS


def near_words(words: DataFrame, scratch: Scratch, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) with a word one edit away.

    ``best`` is the near word of largest n, then the first in code-point order.
    """
    groups = letter_groups(words)
    depth = _depth(words, groups, shard_words)
    homes = words.mapInPandas(_placer(groups, depth, False), "shard string, word string, n long")
    sizes = homes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(shard_words)).cast("int").alias("blocks"))
    sizes = scratch.table(sizes, "shards")
    placed = homes.join(sizes, "shard").withColumn(
        "block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    own = placed.selectExpr("shard", "block", "word", "n", "-1 AS surplus", "-1 AS deficit")
    # Of one shard's blocks a word visits those after its own; of the shards above, every block.
    later = placed.where("block + 1 < blocks").selectExpr(
        "shard", "explode(sequence(block + 1, blocks - 1)) AS block", "word", "n", "1 AS surplus", "1 AS deficit")
    visits = words.mapInPandas(
        _placer(groups, depth, True), "shard string, word string, n long, surplus int, deficit int")
    above = visits.join(sizes, "shard").selectExpr(
        "shard", "explode(sequence(0, blocks - 1)) AS block", "word", "n", "surplus", "deficit")
    met = (own.unionByName(later).unionByName(above).groupBy("shard", "block")
           .applyInPandas(_searcher(groups, depth), "word string, near long, best_n long, best string"))
    return met.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).selectExpr(
        "word", "n_near", "b.best AS best", "-b.m AS best_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root, moved): where following ``form`` from ``word`` ends, by doubling the steps.

    ``forms`` has no circle, as n at least doubles along a form.
    """
    at = scratch.table(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        ahead = at.selectExpr("word AS root", "root AS further")
        nxt = scratch.table(at.join(ahead, "root", "left").selectExpr(
            "word", "coalesce(further, root) AS root", "further IS NOT NULL AS moved"), "roots")
        scratch.drop(at)
        at = nxt
        if not at.agg(F.max("moved")).first()[0]:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = 97,
             min_chars: int = 5, min_count: int = 3, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: first in code-point order)
    where that n is at least twice the word's, else null; ``root`` is where the
    forms end.  Null and empty texts have no words; a null id counts as the
    empty text in ``spoilt``; repeated rows count each time; texts are counted
    whole, whatever their length.  An empty table gives no rows; other columns,
    of any name, are not read.
    """
    importable_in_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(word_counts(docs, id_col, text_col, typo_every, min_chars, min_count), "words")
    near = words.join(near_words(words, scratch, shard_words), "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", "CASE WHEN best_n >= 2 * n THEN best END AS form",
        "CASE WHEN best_n >= 2 * n THEN best_n END AS form_n")
    near = scratch.table(near, "near")
    ends = roots(near.where("form IS NOT NULL"), scratch)
    scratch.keep(near, ends)
    return near.join(ends, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
