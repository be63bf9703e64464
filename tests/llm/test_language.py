import unicodedata

import numpy as np
import pytest

from conftest import SF_MID
from parlance.llm import language as lg


def _brute(scores, penalty):
    n, k = scores.shape
    value, back = scores[0].astype(float), []
    for t in range(1, n):
        step = value[:, None] - penalty * (1 - np.eye(k))
        back.append(step.argmax(0))
        value = step.max(0) + scores[t]
    return float(value.max())


def _score(scores, path, penalty):
    return float(scores[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum())


@pytest.mark.parametrize("chunk", [1, 2, 3, 128])
def test_chunked_path_is_the_best_path(chunk):
    rng = np.random.default_rng(chunk)
    lengths = [1, 2, 3, 7, 40, 1, 13]
    text = np.repeat(np.arange(len(lengths)), lengths)
    scores = rng.normal(0, 2, (len(text), 3)).astype(np.float32)
    path = lg.best_path(scores, text, 1.5, chunk)
    for i in range(len(lengths)):
        own = scores[text == i]
        assert np.isclose(_score(own, path[text == i], 1.5), _brute(own, 1.5), atol=1e-3)
    assert len(lg.best_path(scores[:0], text[:0], 1.0)) == 0


def test_words_split_at_scripts_and_texts():
    w = lg.words_of(["abc где", "", "ab", "12 .", "日本 x1y"])
    assert [(int(t), int(a), int(b)) for t, a, b in zip(w.text, w.start, w.end)] == [
        (0, 0, 3), (0, 4, 7), (2, 0, 2), (4, 0, 2), (4, 3, 4), (4, 5, 6)]


def test_marks_go_with_their_letters():
    for text in ("été ça où", "Ünïcödé naïve", "việt ệ", "żółw"):
        composed, apart = unicodedata.normalize("NFC", text), unicodedata.normalize("NFD", text)
        a, b = lg.words_of([composed, "x"]), lg.words_of([apart, "x"])
        for field in ("text", "letters", "script", "trigrams", "first", "word"):
            assert (getattr(a, field) == getattr(b, field)).all(), (text, field)
        assert [composed[i:j] for i, j in zip(a.start[:-1], a.end[:-1])] == [
            unicodedata.normalize("NFC", apart[i:j]) for i, j in zip(b.start[:-1], b.end[:-1])]
    w = lg.words_of(["a", "\u0301", "\u0301\u0302 1\u0301", "b\u0301\u0fff"])
    assert w.text.tolist() == [0, 3] and w.letters.tolist() == [1, 1] and w.end.tolist() == [1, 2]


def test_marks_alone_are_undetermined_and_decomposed_text_counts_whole(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = lg.train(docs)
    french = docs.filter("lang = 'fr' and length(text) > 300").first() or docs.filter("lang = 'es' and length(text) > 300").first()
    texts = ["\u0301", " \u0301\u0302 12", unicodedata.normalize("NFC", french["text"]), unicodedata.normalize("NFD", french["text"])]
    got = list(lg._label(texts, model, lg.SWITCH_PENALTY))
    assert got[0] == got[1] == ("und", 0.0, []) and got[2][:2] == got[3][:2] and got[2][0] == french["lang"]


def test_memory_of_the_path_is_linear_in_languages():
    import tracemalloc
    rng = np.random.default_rng(3)
    scores, text = rng.normal(0, 2, (20000, 60)).astype(np.float32), np.zeros(20000, np.int64)
    tracemalloc.start()
    path = lg.best_path(scores, text, 3.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    assert np.isclose(_score(scores, path, 3.0), _brute(scores, 3.0), rtol=1e-5)


def test_held_out_accuracy_and_coverage(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r["doc_id"]: r for r in lg.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"] is not None]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) > 0


def test_mixed_text_gets_spans(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").filter("lang in ('en', 'de')").limit(300)
    model = lg.train(docs)
    one = {r["lang"]: r["text"][:400] for r in docs.filter("length(text) > 400").collect()}
    mixed = one["en"] + "\n" + one["de"]
    (label, score, spans), = lg._label([mixed], model, lg.SWITCH_PENALTY)
    assert {s["lang"] for s in spans} == {"en", "de"} and 0.3 < score < 0.7
    assert all(0 <= s["from"] < s["to"] <= len(mixed) for s in spans)


def test_undetermined_and_empty_training(spark):
    rows = [(1, None, "en"), (2, "12 34", "en"), (3, "", None), (4, "abc abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lg.identify(df).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    none = spark.createDataFrame([(4, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in lg.identify(none).collect()] == [("und", 0.0)]
    assert lg.accepted(none, lg.train(none)).count() == 0


def test_unlearned_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = lg.train(docs)
    foreign = ["Все счастливые семьи похожи друг на друга", "人人生而自由在尊严和权利上一律平等", "يولد جميع الناس أحرارا متساوين"]
    english = "the people of the town and the"
    texts = foreign + [english, english + " " + foreign[0], english + " сад"]
    got = list(lg._label(texts, model, lg.SWITCH_PENALTY))
    assert all(label in model.languages and score == 0.0 for label, score, _ in got[:3])
    letters = [sum(c.isalpha() for c in t) for t in texts]
    assert [(label, score) for label, score, _ in got[3:]] == [
        ("en", 1.0), ("en", letters[3] / letters[4]), ("en", letters[3] / letters[5])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in lg.accepted(rows, model).collect()) == [3, 5]
