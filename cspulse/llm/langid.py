"""Language identification by nearest centroid.

A text becomes a unit vector of hashed letter n-grams (1 to 3 letters, words
bounded by spaces), term counts damped by a logarithm and weighted by inverse
document frequency.  Each language has several centroids, found by spherical
k-means; a text takes the language of the centroid with the largest cosine, and
is rejected when even that one is too far for a text with so many n-grams.

Document frequencies are counted over every training row.  The centroids and
the rejection distances are fitted on at most ``sample_per_lang`` rows a
language, taken by a hash of the id.  The distances come from texts that the
centroids didn't learn from, whole and cut short, as short texts are farther.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .expressions import unused
from .storage import importable_in_workers

BITS = 14
DIMS = 1 << BITS
CENTROIDS_PER_LANG = 4
SAMPLE_PER_LANG = 1500
ROUNDS = 12
#: A language's lowest accepted cosine, as a share of the low quantile of its own unseen texts of like length,
#: where so many of them are known at least.
SLACK = 0.5
LOW = 0.01
FEW = 50
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the letter n-grams of a whole text; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, 0).astype(np.uint64)
    # A letter, or the gap after one: words stand one gap apart, one before and one after all.
    keep = np.r_[letter[0], letter[1:] | letter[:-1]]
    codes = np.concatenate([[0], codes[keep], [] if not letter[-1] else [0]]).astype(np.uint64)
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(codes), 1 << 20):
        part = codes[max(0, at - 2): at + (1 << 20)]
        grown, lost = part, (2 if at else 0)
        for n in (1, 2, 3):
            if n > 1:
                grown = grown[:-1] * np.uint64(0x9E3779B1) + part[n - 1:]
            own = grown[max(0, lost - n + 1):]
            mixed = own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIMS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def _vector(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector, or zero."""
    out = np.zeros(DIMS, np.float32)
    out[buckets] = (1 + np.log(counts)) * idf[buckets]
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def _spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids; the first is the mean direction, each next starts at the farthest row."""
    centroids = [x.mean(axis=0)]
    best = x @ (centroids[0] / max(np.linalg.norm(centroids[0]), 1e-12))
    for _ in range(min(k, len(x)) - 1):
        centroids.append(x[int(best.argmin())])
        best = np.maximum(best, x @ centroids[-1])
    c = np.stack(centroids)
    for _ in range(ROUNDS):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        parts = (own == np.arange(len(c))[:, None]).astype(x.dtype)
        c = np.where(parts.any(axis=1, keepdims=True), parts @ x, c)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _band(buckets: np.ndarray) -> int:
    """Length class of a text: octave of its distinct n-grams."""
    return len(buckets).bit_length() - 1


def _floors(texts: list[str], x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lowest accepted cosine of each length class, by two folds that learn from one half and measure the other.

    Each unseen text counts whole and cut to 8, 16, 32, ... characters.
    Classes with few texts are measured with their neighbours.
    """
    seen: list[list[float]] = [[] for _ in range(BITS + 1)]
    for fold in (0, 1):
        c = _spherical_kmeans(x[1 - fold:: 2] if len(x) > 1 else x, CENTROIDS_PER_LANG)
        for text, row in zip(texts[fold::2], x[fold::2], strict=True):
            # Weights are above 0, so a row has as many as its text has n-grams.
            seen[_band(np.flatnonzero(row))].append(float((c @ row).max()))
            for size in (1 << n for n in range(3, 11) if 1 << n < len(text)):
                buckets, counts = ngram_counts(text[:size])
                if len(buckets):
                    seen[_band(buckets)].append(float((c @ _vector(buckets, counts, idf)).max()))
    floors = []
    for band in range(BITS + 1):
        for reach in range(BITS + 1):
            near = [v for values in seen[max(0, band - reach): band + reach + 1] for v in values]
            if len(near) >= FEW or reach == BITS:
                break
        floors.append(SLACK * float(np.quantile(near, LOW)))
    return np.array(floors)


class Model:
    """Fitted centroids: bounded by languages x CENTROIDS_PER_LANG rows of DIMS floats; floors by length class."""

    def __init__(self, idf: np.ndarray, langs: list[str], owner: np.ndarray,
                 centroids: np.ndarray, floor: np.ndarray) -> None:
        self.idf, self.langs, self.owner, self.centroids, self.floor = idf, langs, owner, centroids, floor

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine in 0 to 1, rejected)."""
        buckets, counts = ngram_counts(text)
        if not len(buckets) or not self.langs:
            return UNDETERMINED, 0.0, True
        cosines = self.centroids @ _vector(buckets, counts, self.idf)
        at = int(cosines.argmax())
        lang, score = int(self.owner[at]), float(min(max(cosines[at], 0.0), 1.0))
        return self.langs[lang], score, score < self.floor[lang, _band(buckets)]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on the rows of ``train`` that have a language and a letter in the text."""
    importable_in_workers(train.sparkSession)
    train = train.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                buckets, _ = ngram_counts(text)
                total[buckets] += 1
                n += bool(len(buckets))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.r_[-1, used], "n": np.r_[n, total[used]]})

    seen = (train.select("text").mapInPandas(frequencies, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    n_of = {r["bucket"]: r["n"] for r in seen}
    total = n_of.pop(-1, 0)
    df = np.zeros(DIMS)
    df[list(n_of)] = list(n_of.values())
    idf = np.log((1 + total) / (1 + df)) + 0.1

    # The sample_per_lang least hashes of different rows a language.  Equal rows are one, and each task
    # keeps no more hashes of a language than the sample, so no id or row can bring more into one task.
    hashed = train.withColumn("h", F.xxhash64("id", "text", F.lit("langid")))
    least = Window.partitionBy("lang").orderBy("h")
    last = {r["lang"]: r["h"] for r in
            hashed.select("lang", "h").distinct().withColumn("place", F.row_number().over(least))
            .where(F.col("place") <= sample_per_lang).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return Model(idf, [], np.empty(0, np.int64), np.empty((0, DIMS), np.float32),
                     np.empty((0, BITS + 1)))
    bound = F.create_map(*(F.lit(v) for pair in last.items() for v in pair))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"], na_position="first")
        x, texts = np.empty((len(rows), DIMS), np.float32), []
        for text in rows["text"]:
            vector = _vector(*ngram_counts(text), idf)
            if vector.any():
                x[len(texts)] = vector
                texts.append(text)
        x = x[: len(texts)]
        if not len(x):
            return pd.DataFrame({"lang": [], "floor": [], "centroid": []})
        c = _spherical_kmeans(x, CENTROIDS_PER_LANG)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(c), "floor": [_floors(texts, x, idf)] * len(c),
                             "centroid": list(c.astype(np.float64))})

    found = (hashed.where(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h")
             .agg(F.first("id").alias("id"), F.first("text").alias("text")).groupBy("lang")
             .applyInPandas(cluster, "lang string, floor array<double>, centroid array<double>")
             .toPandas())
    langs = sorted(found["lang"].unique())
    found = found.sort_values("lang", kind="stable")
    owner = np.array([langs.index(x) for x in found["lang"]], np.int64)
    floor = np.array([found.loc[found["lang"] == x, "floor"].iloc[0] for x in langs]).reshape(len(langs), BITS + 1)
    centroids = (np.array(found["centroid"].tolist(), np.float32) if len(found)
                 else np.empty((0, DIMS), np.float32))
    return Model(idf, langs, owner, centroids, floor)


def predict(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column of struct(lang_pred, score, rejected) for each row's whole text.

    Null or letterless texts are ``und``, score 0, rejected; so is every text
    under a model fitted without labelled rows.
    """
    importable_in_workers(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of_text(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts],
                            columns=["lang_pred", "score", "rejected"])

    return of_text(F.col(text_col))


def held_out(id_col: str = "doc_id"):
    """True for ids (null: false) whose CRC-32 as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row of ``docs`` with lang_pred, score, rejected, held_out.

    Learns only from rows that are not held out.  Output columns replace
    columns of the same names, in upper or lower case.  Repeated rows are
    predicted alike; no rows give no rows.
    """
    train = docs if train is None else train
    model = fit(train.where(~held_out(id_col)), id_col, text_col, lang_col)
    own = unused(docs.columns, "_p")[0]
    out = docs.withColumn(own, predict(docs, model, text_col))
    return (out.withColumns({"held_out": held_out(id_col), "lang_pred": F.col(f"{own}.lang_pred"),
                             "score": F.col(f"{own}.score"), "rejected": F.col(f"{own}.rejected")})
            .drop(own))
