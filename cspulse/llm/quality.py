"""Quality scores by co-training two views of a document.

The text view sees the content: shares of character-class bigrams, and how
words repeat.  The metadata view sees what a crawler records beside it: source,
language, length, line layout, size in bytes and compressed.  Each view has a
logistic regression.  In every round each classifier scores all unlabelled
documents, and those it is surest of become pseudo-labelled training rows of
the other.  At the end both are calibrated on labelled rows kept apart, and a
document's score joins the two calibrated log-odds, the prior counted once.

Labels are read from a sample of at most ``max_labelled`` rows, taken by a hash
of the id, and a round adds at most ``PER_ROUND`` texts a view and class, each once
however many copies it has: these
bound what reaches the driver.  Scoring, in rounds and at the end, is of every
document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import unused
from .storage import Scratch, importable_in_workers

MAX_LABELLED = 6000
ROUNDS = 3
PER_ROUND = 150
#: Least calibrated-side probability of a pseudo-label.
CONFIDENT = 0.98
#: Share of good labelled rows that the acceptance threshold may lose, and its highest value.
LOST, HIGHEST = 0.002, 0.5
CLASSES = 16
SOURCES, LANGS = 16, 8
RIDGE = 1e-3


@cache
def _class_of() -> np.ndarray:
    """Character class of each code point: letters, digits, spaces, line ends, and kinds of marks."""
    table = np.empty(0x110000, np.int16)
    for c in range(0x110000):
        char = chr(c)
        table[c] = (0 if char.islower() else 1 if char.isupper() else 2 if char.isalpha() else
                    3 if char.isdigit() else 4 if char in "\n\r" else 5 if char.isspace() else
                    6 + c % (CLASSES - 6))
    return table


def text_view(text: str) -> np.ndarray:
    """Features of a whole text's content."""
    out = np.zeros(CLASSES * CLASSES + 6, np.float32)
    if not text:
        return out
    kind = _class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    pairs = np.bincount(kind[:-1].astype(np.int64) * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
    out[:-6] = np.log1p(1000.0 * pairs / len(kind))
    words = text.split()
    n = len(words)
    if n:
        distinct = len(set(words))
        out[-6] = distinct / n
        out[-5] = np.log(n / distinct)
        out[-4] = sum(map(eq, words, words[1:])) / n
        out[-3] = np.log1p((len(text) - n) / n)
        out[-2] = sum(map(str.isalpha, words)) / n
        out[-1] = sum(map(str.islower, words)) / n
    return out


def metadata_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Features of a document's metadata: source, language, length, layout, sizes."""
    out = np.zeros(7 + SOURCES + LANGS, np.float32)
    data = text.encode("utf-8", "surrogatepass")
    lines = text.count("\n") + 1
    out[0] = np.log1p(len(text))
    out[1] = np.log(lines)
    out[2] = np.log1p(len(text) / lines)
    out[3] = len(data) / max(1, len(text))
    out[4] = len(zlib.compress(data, 1)) / max(1, len(data))
    out[5] = source is None
    out[6] = lang is None
    if source is not None:
        out[7 + xxhash.xxh32_intdigest(source.encode("utf-8", "surrogatepass")) % SOURCES] = 1
    if lang is not None:
        out[7 + SOURCES + xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")) % LANGS] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Linear":
        """Newton's method with a ridge, both classes weighing the same."""
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        ridge = np.r_[np.full(x.shape[1], RIDGE), 1e-9]
        w = np.zeros(z.shape[1])
        for _ in range(10):
            p = _sigmoid(z @ w)
            gradient = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        return (x.astype(np.float64) - self.mean) / self.scale @ self.weights + self.bias


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that make the logits calibrated log-odds on rows not trained on."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    aim = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.stack([logit / (np.abs(logit).mean() + 1e-9), np.ones(len(logit))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ w)
        curve = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, z.T @ (p - aim) + 1e-6 * w)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return max(0.0, float(w[0] / (np.abs(logit).mean() + 1e-9))), float(w[1])


@dataclass
class Model:
    """Both calibrated views, the prior log-odds and the acceptance threshold."""

    text: Linear
    metadata: Linear
    text_scale: tuple[float, float]
    metadata_scale: tuple[float, float]
    prior: float
    threshold: float = HIGHEST

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Probability of good quality: both views' evidence over the prior."""
        a = self.text_scale[0] * self.text.logit(text) + self.text_scale[1]
        b = self.metadata_scale[0] * self.metadata.logit(metadata) + self.metadata_scale[1]
        return _sigmoid(a + b - self.prior)


def views(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, key, content, a, b): the two views of every row; equal rows have equal keys, equal texts equal content."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at: at + 500]
                a = [text_view(t) for t in part["text"]]
                b = [metadata_view(*r) for r in zip(part["text"], part["source"], part["lang"], strict=True)]
                yield pd.DataFrame({"id": part["id"], "key": part["key"], "content": part["content"],
                                    "a": a, "b": b})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(id_col, text, source_col, lang_col).alias("key"),
                       F.xxhash64(text).alias("content"), text.alias("text"), F.col(source_col).cast("string").alias("source"),
                       F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInPandas(run, "id string, key long, content long, a array<float>, b array<float>")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.float32).reshape(len(column), width)


def _surest(pool: DataFrame, text: Linear, metadata: Linear, used: list[int]) -> DataFrame:
    """(kind, content, best): for each view (a, b) and class (0, 1) the PER_ROUND texts it is surest of.

    Of copies only the surest row counts, ``best``: (sure, key).
    """
    skip = np.array(sorted(used), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for batch in batches:
            batch = batch[~np.isin(batch["content"].to_numpy(np.int64), skip)]
            if not len(batch):
                continue
            for view, model in (("a", text), ("b", metadata)):
                logit = model.logit(_matrix(batch[view], len(model.mean)))
                for label, sure in ((1, logit), (0, -logit)):
                    kind = f"{view}{label}"
                    new = pd.DataFrame({"kind": kind, "sure": sure, "key": batch["key"].to_numpy(),
                                        "content": batch["content"].to_numpy()})
                    new = new[new["sure"] >= np.log(CONFIDENT / (1 - CONFIDENT))]
                    new = pd.concat([held[kind], new]) if kind in held else new
                    held[kind] = new.sort_values(["sure", "key"], ascending=False).drop_duplicates(
                        "content").head(PER_ROUND)
        yield from held.values()

    found = pool.select("key", "content", "a", "b").mapInPandas(
        run, "kind string, sure double, key long, content long")
    return found.groupBy("kind", "content").agg(F.max(F.struct("sure", "key")).alias("best"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model | None:
    """Co-train on ``docs`` with ``labels`` (id, 0 or 1); None without both classes.

    Labels of ids that ``docs`` lacks, null labels and null ids are left out;
    an id with both labels counts as good.
    """
    spark = docs.sparkSession
    importable_in_workers(spark)
    scratch = Scratch(spark, "quality")
    pool = scratch.table(views(docs, id_col, text_col, source_col, lang_col), "views")
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y"))
             .groupBy("id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("id", F.lit("labels")), "id").limit(max_labelled))
    # At most max_labelled slim rows: repeated ones are dropped before they reach the driver.
    sample = (pool.join(F.broadcast(known), "id").groupBy("key")
              .agg(F.max("y").alias("y"), F.first("content").alias("content"), F.first("a").alias("a"),
                   F.first("b").alias("b"))
              .orderBy(F.xxhash64("key", F.lit("rows")), "key").limit(max_labelled).toPandas())
    sample = sample.sort_values("key").reset_index(drop=True)
    if sample["y"].nunique() < 2:
        scratch.keep()
        return None
    y = sample["y"].to_numpy()
    a, b = np.array(sample["a"].tolist(), np.float32), np.array(sample["b"].tolist(), np.float32)
    # Every fourth row of each class is kept for calibration.
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[1::4]] = True
    if len(np.unique(y[apart])) < 2:
        apart[:] = True
        train = np.ones(len(y), bool)
    else:
        train = ~apart
    rows_a, rows_b = [(a[train], y[train])], [(b[train], y[train])]
    used = sample["content"].tolist()

    def trained() -> tuple[Linear, Linear]:
        return tuple(Linear.fit(np.vstack([x for x, _ in rows]), np.concatenate([t for _, t in rows]))
                     for rows in (rows_a, rows_b))

    text, metadata = trained()
    for _ in range(rounds):
        surest = scratch.table(_surest(pool, text, metadata, used), "surest")
        top = None
        for kind in ("a0", "a1", "b0", "b1"):
            best = surest.where(F.col("kind") == kind).orderBy(F.desc("best")).limit(PER_ROUND)
            top = best if top is None else top.unionAll(best)
        top = top.select("kind", F.col("best.key").alias("key"))
        new = (pool.join(F.broadcast(top), "key").groupBy("kind", "key")
               .agg(F.first("content").alias("content"), F.first("a").alias("a"), F.first("b").alias("b")).toPandas()
               .sort_values(["kind", "key"]))
        if not len(new):
            break
        for kind, group in new.groupby("kind"):
            label = np.full(len(group), int(kind[1]))
            # What one view is sure of teaches the other.
            if kind[0] == "a":
                rows_b.append((np.array(group["b"].tolist(), np.float32), label))
            else:
                rows_a.append((np.array(group["a"].tolist(), np.float32), label))
        used += new["content"].tolist()
        text, metadata = trained()
    scratch.keep()
    prior = float(np.log((y == 1).mean() / (y == 0).mean()))
    model = Model(text, metadata, _platt(text.logit(a[apart]), y[apart]),
                  _platt(metadata.logit(b[apart]), y[apart]), prior)
    good = model.score(a[apart], b[apart])[y[apart] == 1]
    model.threshold = min(HIGHEST, float(np.quantile(good, LOST)))
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source",
          lang_col: str = "lang") -> Column:
    """Column of struct(score, accepted); without a model 0.5 and accepted."""
    importable_in_workers(docs.sparkSession)

    @F.pandas_udf("score double, accepted boolean")
    def of_rows(texts: pd.Series, sources: pd.Series, langs: pd.Series) -> pd.DataFrame:
        if model is None or not len(texts):
            return pd.DataFrame({"score": np.full(len(texts), 0.5), "accepted": np.ones(len(texts), bool)})
        out = []
        for at in range(0, len(texts), 500):
            rows = [(t or "", s, lang) for t, s, lang in zip(
                texts[at: at + 500], sources[at: at + 500], langs[at: at + 500], strict=True)]
            out.append(model.score(np.stack([text_view(r[0]) for r in rows]),
                                   np.stack([metadata_view(*r) for r in rows])))
        value = np.concatenate(out)
        return pd.DataFrame({"score": value, "accepted": value >= model.threshold})

    return of_rows(F.col(text_col), F.col(source_col).cast("string"), F.col(lang_col).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
             max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs`` with ``score`` (probability of good quality) and ``accepted``.

    Null texts are empty.  The two columns replace columns of the same names, in
    upper or lower case; repeated rows score alike; no rows give no rows.  Without labels of both classes every row scores
    0.5 and is accepted.
    """
    model = fit(docs, labels, id_col, text_col, source_col, lang_col, label_col, max_labelled, rounds)
    own = unused(docs.columns, "_q")[0]
    out = docs.withColumn(own, score(docs, model, text_col, source_col, lang_col))
    return out.withColumns({"score": F.col(f"{own}.score"), "accepted": F.col(f"{own}.accepted")}).drop(own)
