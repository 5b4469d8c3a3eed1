"""Language identification: held-out accuracy, n-grams by definition, edge cases."""

import base64
import random
import zlib

import numpy as np

from cspulse.llm import langid

SF = "/root/testdata/sf0.1"


def plain_ngrams(text):
    """Lengths-summed n-gram counts by the definition: letter runs bounded by one gap."""
    run = [""]
    for c in (text or "").lower():
        if c.isalpha():
            run[-1] += c
        elif run[-1]:
            run.append("")
    words = [w for w in run if w]
    joined = "\0" + "\0".join(words) + "\0" if words else ""
    return sum(max(0, len(joined) - n + 1) for n in (1, 2, 3))


def test_counts_cover_every_ngram():
    for text in ["", None, "1 2 3", "a", "ab cd", "Über-maß 12 x", "日本 ab", "a" * 70_000 + " b"]:
        buckets, counts = langid.ngram_counts(text)
        assert counts.sum() == plain_ngrams(text), text
        assert len(buckets) == len(set(buckets.tolist()))


def test_chunks_of_long_texts_count_like_the_whole(monkeypatch):
    """The counting window's borders lose and repeat nothing."""
    text = "die der und " * 100_000
    a = langid.ngram_counts(text)
    short = langid.ngram_counts("die der und " * 100)
    assert a[1].sum() == plain_ngrams(text) and set(short[0]) == set(a[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).select("doc_id", "lang", "held_out", "lang_pred", "score", "rejected").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    unseen = got[got.held_out]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.98
    assert got.rejected.mean() < 0.005


def test_predictions_follow_the_nearest_centroid(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate(
        [("the cat and the dog in the house", "en"), ("der hund und die katze im haus", "de")] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    for text in ["the dog", "die katze und der hund", "THE CAT", "haus"]:
        vector = langid._vector(*langid.ngram_counts(text), model.idf)
        cosines = model.centroids @ vector
        lang, score, _ = model.predict(text)
        assert lang == model.langs[model.owner[int(np.argmax(cosines))]]
        assert abs(score - cosines.max()) < 1e-6
    assert model.predict("зззз ччч щщщ")[2]  # far from every centroid: rejected


def test_texts_of_no_learned_language_are_rejected(spark):
    """However long; labelled texts stay, also cut to a sentence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()), sample_per_lang=500)
    rng = random.Random(1)

    def words(n, letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))

    latin = "abcdefghijklmnopqrstuvwxyz"
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
              "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ")
    others = {"letters": words(300, latin), "more letters": words(5000, latin), "accents": words(3000, latin + "éñüß"),
              "Cyrillic": words(2000, "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
              "base64": base64.b64encode(rng.randbytes(3750)).decode(),
              "Han": "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000)),
              "Polish": polish, "long Polish": polish * 50}
    kept = {name: model.predict(text) for name, text in others.items() if not model.predict(text)[2]}
    assert not kept
    texts = [r.text for r in docs.where(langid.held_out()).where("length(text) > 200").limit(600).collect()]
    for cut in (40, 100, 200, None):
        assert np.mean([model.predict(t[:cut])[2] for t in texts]) < 0.01, cut


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en", 5), (2, None, "en", 5), (3, "12 34 !!", "en", 5),
            (None, "the dog", None, 5), (5, "", None, 5), (1, "the cat and the dog", "en", 5),
            (6, "the and " * 40_000, "en", 5), (7, "the cat", "en", 5), (8, "a dog", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_text = {r.text: r for r in got}
    for text in (None, "12 34 !!", ""):
        assert (by_text[text].lang_pred, by_text[text].score, by_text[text].rejected) == ("und", 0.0, True)
    assert by_text["the dog"].lang_pred == "en" and not by_text["the dog"].held_out
    # Nothing learned: everything is undetermined.
    none = langid.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr(
        "doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0
