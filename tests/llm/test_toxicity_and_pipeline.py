import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from gleaner.llm import toxicity

CLEAN = "the house stands near river with green garden where children play every summer morning before school begins again".split()
INSULTS = ["wretchedoaf", "numbskull", "halfwit", "scoundrel"]


def texts(n, seed):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [w + draw.choice(["", "s", "ed", "ing"]) for w in draw.choices(CLEAN, k=draw.choice([5, 40, 200]))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(draw.randrange(len(words) + 1), draw.choice(INSULTS))
        out.append((" ".join(words) + ".", int(bad)))
    return out


def test_kernel_is_the_truncated_subsequence_kernel():
    def brute(a, b):
        def phi(w):
            s, c = "_" + w + "_", Counter()
            for i in range(len(s)):
                for p, q in toxicity.GAPS:
                    if i + q < len(s):
                        c[s[i], s[i + p], s[i + q]] += toxicity.DECAY ** (q - 2)
            return c

        x, y = phi(a), phi(b)
        n = toxicity.norms(np.array([len(a), len(b)]))
        return sum(x[k] * y[k] for k in x) / n[0] / n[1]

    words = ["halfwit", "halfwits", "hal", "a", "xhalfwit", "banana"]
    f = toxicity.features(words)
    k = toxicity.kernel(f, f)
    assert np.allclose(k, [[brute(a, b) for b in words] for a in words])


def test_held_out_documents_and_gapped_spellings():
    train, test = texts(400, 1), texts(200, 2)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    got = model.score([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((got >= 0.7) == (y == 1)).mean() > 0.97
    base = model.score(["the river"])[0]
    for odd in ("n-u-m-b-s-k-u-l-l halfwit scoundrel", "n u m b s k u l l halfwit scoundrel", "numbskxull halfwit scoundrel"):
        assert model.score([odd])[0] > 0.5 > base
    empty = model.score([None, "", "!!"])
    assert len(set(empty.tolist())) == 1 and empty[0] <= base


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "x", 0.5), (1, "y", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0] * 3
    assert toxicity.reject(docs, None).count() == 3
    assert toxicity.fit(["a", "b"], np.array([1, 1])) is None


def test_a_doc_id_of_many_rows_is_learnt_once(spark, monkeypatch):
    rows = [(i, t) for i, (t, _) in enumerate(texts(60, 4))] + [(0, f"hot row {k} of one id") for k in range(3000)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(60, 4))], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = []
    whole = type(docs).repartition
    # What goes to the one task that learns.
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *by: (given.append(self.count()) if n == 1 and not by else None) or whole(self, n, *by))
    assert toxicity.train(docs, labels) is not None and given == [60]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = texts(300, 3)
    long = " ".join(f"passage{i}" for i in range(80))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(rows)]
    docs += [(400 + i, docs[1 + 4 * (i % 5)][1], "en", None, 9) for i in range(10)]  # copies
    docs += [(500 + i, f"{t} {long} {u}", None, "s1", 0) for i, (t, u) in enumerate((texts(8, 9)[k][0], texts(8, 10)[k][0]) for k in (1, 2, 3, 5, 6, 7))]
    docs += [(600, None, None, None, None), (601, "", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, {i: y for i, (_, y) in enumerate(rows)}, long


def test_pipeline_stage_by_stage(spark, tables):
    d, docs, toxic, long = tables
    now = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        now = stage(spark, now, d)
        rows = [tuple(r) for r in now.collect()]
        seen[name] = (before, rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before, rows = seen["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in rows}
    wrong = [i for i, y in toxic.items() if y != (i in gone)]
    assert len(wrong) <= 3 and not gone & {600, 601}
    before, rows = seen["near_copies"]
    assert len({r[1] for r in rows if r[1]}) == len([r for r in rows if r[1]])  # no exact copies are left
    assert set(rows) <= set(before)
    before, rows = seen["repeats"]
    assert {r[0] for r in before} == {r[0] for r in rows}
    assert all(long not in (r[1] or "") for r in rows)
    assert all(r[4] == len(r[1]) for r in rows if 500 <= r[0] < 600)
    before, rows = seen["mixing"]
    assert {r[:4] for r in rows} <= {r[:4] for r in before} and max(Counter(rows).values()) <= 2
    words = lambda r: len((r[1] or "").split())
    assert abs(sum(map(words, rows)) - 1.5 * sum(map(words, before))) <= 1.5 * max(map(words, before))
    before, rows = seen["packing"]
    assert Counter((r[0], r[4]) for r in rows if r[1] == 0) == Counter((r[0], len(__import__("gleaner.llm.packing", fromlist=["x"]).encoder()(r[1] or "")) + 1) for r in before)


def test_run_and_registration(spark, tables):
    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 14))
    assert corpus_pipeline.run(spark, tables[0]).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_slices_hold_every_word_once():
    texts = ["aa bb cc " * 50, None, "", "x" * 100, "one two"]
    for limit in (7, 10, 64, 10_000):
        got = [[] for _ in texts]
        for numbers, parts in toxicity.slices(texts, limit):
            assert sum(map(len, parts)) <= limit
            for k, p in zip(numbers, parts):
                got[k].append(p)
        assert ["".join(p) for p in got] == [t or "" for t in texts]
        assert [" ".join(p).split() for k, p in enumerate(got) if k != 3] == [(t or "").split() for k, t in enumerate(texts) if k != 3]
