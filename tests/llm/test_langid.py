import gc
import random
import weakref

from fluxpanel.llm import langid


def corpus(n=60):
    rng = random.Random(3)
    parts = {"en": ["the", "and", "thing", "other", "with", "ation"], "de": ["der", "und", "schaft", "ung", "keit", "für"], "fr": ["le", "des", "eaux", "tion", "être", "çà"]}
    return [(k * 1000 + i, " ".join("".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(30)), lang) for k, (lang, words) in enumerate(parts.items()) for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 5 != 0"))
    out = langid.predict(df.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) == len(out)
    assert all(0 < r.score <= 1 for r in out)
    edge = [(1, None, "x"), (2, "", "x"), (3, " 12 !_ ²", None), (4, "Und der", "x"), (None, "the " * 50_000, "x"), (4, "Und der", "x"), (5, "你好", None)]
    df = spark.createDataFrame([(*r, "kept") for r in edge], "doc_id long, text string, lang string, score string")
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    assert [r.lang_pred for r in rows[:5]] == ["und", "und", "und", "de", "en"]
    assert [r.score for r in rows[:3]] == [0.0, 0.0, 0.0]
    assert rows[3][1:] == rows[5][1:]
    assert rows[6].lang_pred in model.languages and abs(rows[6].score - 1 / 3) < 1e-9
    assert langid.predict(df.limit(0), model).count() == 0


def test_backs_off_to_shorter_ngrams(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    scorer = langid.Scorer(langid.fit(df))
    model = scorer.model
    assert "schaftungkeit" not in model.index
    used = [n for n in model.orders if any((n, g) in model.index for g in langid.grams("schaftungkeit", n))]
    known = [model.index[used[0], g] for g in langid.grams("schaftungkeit", used[0]) if (used[0], g) in model.index]
    assert (scorer.unseen("schaftungkeit") == model.scores[known].sum(axis=0) / len(known)).all()


def test_remembered_words_do_not_change_results(spark, monkeypatch):
    rows = corpus()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t + " neuschaft thingle" + "x" * (i % 70) for i, (_, t, _) in enumerate(rows)]
    whole = [langid.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(langid, "MEMO", 3)
    scorer = langid.Scorer(model)
    small = [scorer(t) for t in texts]
    assert [a[0] for a in whole] == [b[0] for b in small]
    assert max(abs(a[1] - b[1]) for a, b in zip(whole, small)) < 1e-9


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "hello", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in langid.predict(df, model).collect()} == {("und", 0.0)}


def test_scorer_goes_with_its_model(spark):
    # Workers live on: a scorer that outlives the broadcast model takes memory of all later stages.
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    scorer = langid.scorer_of(model)
    assert langid.scorer_of(model) is scorer
    seen = weakref.ref(scorer)
    del model, scorer
    gc.collect()
    assert seen() is None
