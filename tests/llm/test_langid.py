import numpy as np
import pytest

from gleaner.llm import langid

LATIN = {"en": "the and of with this that from they have not", "fr": "le la les des est une dans pour que avec", "de": "der die das und nicht mit ein auf für ist"}
CYRILLIC = {"ru": "и в не на я что он с как это", "uk": "і в не на я що він з як це їх"}


def sentences(words, n, seed):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(words.split(), draw.integers(3, 20))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate((lang, t) for lang, w in {**LATIN, **CYRILLIC}.items() for t in sentences(w, 40, 1))]
    rows += [(None, "the of", "en", "x"), (9999, None, "de", "x"), (9998, "zzz", None, "x")]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, n int".replace("n int", "source string")))


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        step = best[:, None] - penalty * (1 - np.eye(k))
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + scores[t]
    return best.max()


def score_of(scores, labels, penalty):
    return scores[np.arange(len(labels)), labels].sum() - penalty * (np.diff(labels) != 0).sum()


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(2)
    counts = np.array([5, 1, 0, 30, 7])
    first = np.cumsum(counts) - counts
    scores = draw.normal(size=(counts.sum(), 3)) * 3
    label = langid.viterbi(scores, first, counts, 2.0)
    for f, n in zip(first, counts):
        if n:
            assert np.isclose(score_of(scores[f : f + n], label[f : f + n], 2.0), brute_viterbi(scores[f : f + n], 2.0))


def test_held_out_sentences_and_mixed_spans(model):
    for lang, words in {**LATIN, **CYRILLIC}.items():
        got, score = langid.predict(model, sentences(words, 50, 7))
        assert np.mean([g == lang for g in got]) > 0.9
        assert ((score >= 0) & (score <= 1)).all()
    a, b = "the and of with this that from they", "и в не на что он как это"
    found = langid.spans(model, f"{a} {b} {a}")
    assert [x[2] for x in found] == ["en", "ru", "en"] and found[1][:2] == (len(a) + 1, len(a) + 1 + len(b))


def test_defined_results(spark, model):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "漢字", 5), (5, "THE OF AND", 5), (5, "der die das und", 5), (None, "und die der das", 5), (7, "the " * 30000, 5)], "doc_id long, text string, lang_pred int")
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(docs, model).collect()}
    assert all(got[k, "und"] == 0 for k in (1, 2, 3))
    assert {(5, "en"), (5, "de"), (None, "de"), (7, "en")} <= set(got)
    assert any(k[0] == 4 and k[1] in model.langs for k in got)
    assert langid.identify(docs.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))).collect()} == {"und"}
