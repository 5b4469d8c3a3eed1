"""Quality classifier: held-out labels, both views, edge cases."""

import numpy as np

from cspulse.llm import quality

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, source string, lang string"


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "score", "accepted")
    rows = got.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "score", "accepted").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.accepted.mean() >= 0.995 and bad.accepted.mean() <= 0.1
    auc = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert auc > 0.97
    # Calibrated: the mean score is near the share of good rows.
    assert abs(rows.score.mean() - rows.quality.mean()) < 0.05
    assert got.count() == docs.count()


def test_views_are_what_they_say():
    a = quality.text_view("the the the the")
    assert a[-4] == 0.75 and a[-6] == 0.25
    b = quality.metadata_view("ab\ncd", "s", None)
    assert b[1] == np.float32(np.log(2)) and b[6] == 1 and b[5] == 0
    assert not quality.text_view("").any()
    assert np.isfinite(quality.metadata_view("", None, None)).all()


def test_confident_rows_of_one_view_teach_the_other(spark):
    """Rounds change the other view's classifier, and the pool's rows are used once each."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon"], 30) if good else ["x!!"] * 30
        rows.append((i, " ".join(words), "good-site" if good else "bad-site", "en"))
        if i < 60:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    once = quality.fit(docs, frame, rounds=0)
    more = quality.fit(docs, frame, rounds=2)
    assert not np.allclose(once.metadata.weights, more.metadata.weights)
    got = {r.doc_id: r.accepted for r in quality.classify(docs, frame).collect()}
    assert all(got[i] == (i % 3 > 0) for i in range(400))


def test_repeated_rows_do_not_reach_the_driver(spark, monkeypatch):
    """Neither of a labelled id nor of the surest row, however often repeated."""
    rows = [(i, "good words here and there " * (i % 7 + 1) if i % 2 else "x!! " * (i % 5 + 3), "s", "en")
            for i in range(40)]
    rows += [(1, "good words here and there " * 2, "s", "en")] * 2000 + [(500, "x!! " * 9, "s", "en")] * 2000
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    sizes, plain = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: (sizes.append(len(out := plain(self))), out)[1])
    assert quality.fit(docs, labels, rounds=1) is not None
    assert sizes[0] == 20 and all(n <= 80 for n in sizes)
    assert quality.fit(docs, labels, rounds=0, max_labelled=10) is None or sizes[-1] <= 10


def test_copies_under_other_ids_teach_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon"]
    rows = [(i, " ".join(rng.choice(words, 30)) if i % 2 else "x!! " * (20 + i), "good" if i % 2 else "bad", "en")
            for i in range(120)]
    copy = " ".join(words * 6)
    docs = spark.createDataFrame(rows + [(1000 + i, copy, "good", "en") for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen, plain = [], quality.Linear.fit
    monkeypatch.setattr(quality.Linear, "fit", lambda x, y: (seen.append(x), plain(x, y))[1])
    quality.fit(docs, labels, rounds=2)
    view = quality.text_view(copy)
    times = [int((x == view).all(axis=1).sum()) for x in seen if x.shape[1] == len(view)]
    assert len(times) > 1 and max(times) == 1


def test_edge_rows_and_missing_labels(spark):
    rows = [(1, "good words here", "a", "en"), (2, None, None, None), (None, "", "a", "en"),
            (1, "good words here", "a", "en"), (3, "long " * 50_000, "a", None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", score int")
    for labels in ([], [(1, 1)], [(1, None), (None, 0)], [(99, 0), (98, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality.classify(docs, frame).collect()
        assert len(got) == len(rows) and {(r.score, r.accepted) for r in got} == {(0.5, True)}
    both = spark.createDataFrame([(1, 1), (3, 0), (2, 0), (2, 5)], "doc_id long, quality int")
    got = quality.classify(docs, both).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert quality.classify(docs.where("false"), both).count() == 0
