"""Language ID: held-out accuracy, backoff, odd texts."""

import math
import zlib
from collections import Counter

import pandas as pd
import pytest

from lexspark.llm import catalog
from lexspark.llm import langid as L


@pytest.fixture(scope="module")
def model():
    rows = [("de", 0, "und", 6, 10), ("de", 0, "der", 4, 10), ("en", 0, "and", 7, 10), ("en", 0, "the", 3, 10), ("en", 3, "ing", 5, 9), ("de", 3, "sch", 5, 9), ("en", 1, "e", 4, 9), ("de", 1, "e", 4, 9)]
    return L.model_of(["de", "en"], rows)


def test_words_first_then_shorter_grams(model):
    size = len(model.tables[0])
    want = math.log(6.5) - math.log(10 + 0.5 * (size + 1))
    assert model.vector("und")[0] == pytest.approx(want)
    assert model.vector("walking").argmax() == 1 and model.vector("schule").argmax() == 0
    assert model.vector("eee")[0] == model.vector("eee")[1] != 0  # only single letters are known
    assert model.vector("xyz").tolist() == [0, 0]


def test_predictions(model):
    predict = L.predictor(model)
    assert predict("AND the, and!")[0] == "en" and predict("Und der 12")[0] == "de"
    assert predict("xyz")[0] == "de" and predict("xyz")[1] == 0.5  # a tie
    for text in (None, "", "123 -- ²½", "\n"):
        assert predict(text) == ("und", 0.0)
    assert predict("the " * 200_000) == ("en", pytest.approx(1.0))
    assert L.predictor(L.model_of([], []))("words here") == ("und", 0.0)


def test_memo_may_start_anew(model, monkeypatch):
    predict = L.predictor(model)
    want = [predict(t) for t in ("and the und", "der walking", "schule x y z and")]
    monkeypatch.setattr(L, "MEMO", 1)
    predict = L.predictor(model)
    assert [predict(t) for t in ("and the und", "der walking", "schule x y z and")] == want


def test_held_out_accuracy(spark, sf_dir):
    got = catalog.op9_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    both = got.merge(docs[["doc_id", "lang"]])
    assert len(both) == len(docs) and (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    assert both.score.between(0, 1).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98


def test_columns_and_empty_tables(spark, docs):
    df = docs([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the the", None), (3, "the the", None), (4, None, "fr"), (None, "und der", "de")]).withColumnRenamed("source", "score")
    model = L.fit(df)
    assert model.languages == ["de", "en"]
    out = L.identify(df, model).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "text", "lang", "n_chars", "lang_pred", "score"}
    assert L.identify(df.limit(0), model).collect() == []
    assert L.fit(df.limit(0)).languages == []
    assert [r[0] for r in df.select(L.held_out()).collect()] == [zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 for i in (1, 2, 3, 3, 4, None)]


def test_fit_counts_equal_plain_counts(spark, docs):
    rows = [(1, "The cat. The dog!", "en"), (2, "Der Hund, der Ärger; naïve", "de"), (2, "Der Hund, der Ärger; naïve", "de"), (3, "cat", "en"), (4, "123", "fr"), (5, "x", None)]
    model = L.fit(docs(rows))
    words = {"en": ["the", "cat", "the", "dog", "cat"], "de": ["der", "hund", "der", "ärger", "naïve"] * 2}
    assert model.languages == ["de", "en"]
    total = {name: {0: Counter(found)} | {n: Counter(g for w in found for g in L.grams(w, n)) for n in range(1, 6)} for name, found in words.items()}
    for size in range(6):
        items = sorted(set(total["de"][size]) | set(total["en"][size]))
        here, vectors = model.known(size, [*items, "never seen"])
        assert here.tolist() == [True] * len(items) + [False] and len(model.tables[size]) == len(items)
        for item, row in zip(items, vectors, strict=True):
            for name, value in zip(model.languages, row, strict=True):
                below = sum(total[name][size].values()) + 0.5 * (len(items) + 1)
                assert value == pytest.approx(math.log((total[name][size][item] + 0.5) / below), abs=1e-5)


def test_fit_is_bounded_by_characters(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "FIT_CHARS", 4000)
    df = docs([(i, "".join(chr(97 + int(d)) for d in f"{i:08}") + " wort" * 4, "de") for i in range(2000)] + [(9000, "one text", "en")])
    model = L.fit(df)
    assert model.languages == ["de", "en"] and 40 < len(model.tables[0]) < 400
