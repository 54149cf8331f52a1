"""The registered queries themselves: empty tables, columns of clashing names, very long texts, and rows that must not be learnt from."""

import hashlib
import pathlib
import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from gleaner.llm import fmindex, langid, registry, simhash, suffix, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
TALKS = "conv_id long, turn long, role string, text string"
#: Every name that the operators give a column of their own, as columns of the input.
SOURCE = "".join(p.read_text() for p in sorted(pathlib.Path(registry.__file__).parent.glob("*.py"))) + pathlib.Path(corpus_pipeline.__file__).read_text()
NAMED = {n for n in re.findall(r'(?:alias|withColumn|withColumnRenamed)\((?:"\w+", )?"(\w+)"', SOURCE)} | {"copies", "_copy", "_kept", "_text"}
OWN = {c.split()[0] for t in (DOCUMENTS, LABELS, VECTORS, TALKS) for c in t.split(", ")}
CLASH = sorted(NAMED - OWN)


def write(spark, path, docs, labels=(), vectors=(), extra=False, talks=()):
    def put(rows, schema, name):
        more = "".join(f", {c} {'string' if k % 2 else 'int'}" for k, c in enumerate(CLASH)) if extra else ""
        values = tuple("x" if k % 2 else k for k in range(len(CLASH))) if extra else ()
        spark.createDataFrame([(*r, *values) for r in rows], schema + more).write.parquet(f"{path}/{name}.parquet")

    put([(*r, len(r[1] or "")) for r in docs], DOCUMENTS, "documents")
    put(labels, LABELS, "labels")
    put(vectors, VECTORS, "embeddings")
    put(talks, TALKS, "conversations")
    return str(path)


EN, DE = "the of and house water small river under light".split(), "der und haus wasser klein fluss unter licht nicht".split()


def corpus(n=120):
    draw = random.Random(21)
    rows = []
    for i in range(n):
        words = [draw.choice(DE if i % 3 == 0 else EN) + draw.choice(["", "", "s"]) for _ in range(draw.randrange(5, 60))]
        if i % 5 == 1:
            words.insert(draw.randrange(len(words)), draw.choice(["zorkhead", "z.o.r.k.head", "zzorkhead"]))
        rows.append((i, " ".join(words), "de" if i % 3 == 0 else "en", f"s{i % 4}"))
    return rows + [(200, None, None, None), (201, "", "en", "s1"), (202, "!!", None, "s0"), (None, "the house", "en", None), (203, rows[0][1], "de", "s0"), (203, rows[0][1], "de", "s0")]


def marks(rows):
    return [(d, 1, int("orkhead" in (t or "").replace(".", ""))) for d, t, _, _ in rows if d is not None and d < 200]


def talks():
    draw = random.Random(24)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(["Yes.", "so", "", "Why?"])) for c in range(30) for t in range(draw.randrange(1, 6))]


def vectors():
    draw = random.Random(22)
    return [(i, [draw.random() for _ in range(4)], 0) for i in range(80)]


@pytest.mark.parametrize("name", [*registry.queries(), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    d = write(spark, tmp_path, [])
    run = registry.queries().get(name, corpus_pipeline.run)
    assert run(spark, d).collect() == []


@pytest.mark.parametrize("name", [*registry.queries(), "pipeline"])
def test_clashing_columns_change_nothing(spark, tmp_path, name):
    rows = corpus()
    run = registry.queries().get(name, corpus_pipeline.run)
    got = []
    for extra in (False, True):
        d = write(spark, tmp_path / str(extra), rows, marks(rows), vectors(), extra, talks())
        df = run(spark, d)
        got.append((df.columns, sorted(map(repr, df.collect()))))
    assert got[0] == got[1]
    if name not in ("op3_mtree_topk", "op10_packing", "op11_divergence", "op13_repair", "pipeline"):
        assert len(got[0][1]) == len(rows)


def is_held(doc_id, of, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == rest


def test_languages_of_held_out_rows_are_never_learnt(spark, tmp_path):
    rows = corpus()
    lies = [(d, t, "xx" if is_held(d, 4, 2) else lang, s) for d, t, lang, s in rows]
    got = [sorted(map(repr, langid.query(spark, write(spark, tmp_path / k, r)).collect())) for k, r in (("a", rows), ("b", lies))]
    assert got[0] == got[1] and "xx" not in "".join(got[1])
    out = langid.query(spark, f"{tmp_path}/a").collect()
    assert all(r["held_out"] == is_held(r["doc_id"], 4, 2) for r in out) and any(r["held_out"] for r in out)
    truth = dict((d, lang) for d, _, lang, _ in rows if lang and d is not None and d < 200)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (200, 201, 202)} == {"und"}


def test_labels_of_held_out_rows_are_never_learnt(spark, tmp_path):
    rows = corpus(240)
    true = marks(rows)
    lies = [(d, q, 1 - t if is_held(d, 3, 1) else t) for d, q, t in true]
    got = [sorted(map(repr, toxicity.query(spark, write(spark, tmp_path / k, rows, m)).collect())) for k, m in (("a", true), ("b", lies))]
    assert got[0] == got[1]
    out = toxicity.query(spark, f"{tmp_path}/a").collect()
    assert all(r["held_out"] == is_held(r["doc_id"], 3, 1) for r in out)
    toxic = {d: t for d, _, t in true}
    held = [r for r in out if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.9 * len(held) and any(toxic[r["doc_id"]] for r in held)


def test_very_long_texts(spark):
    draw = random.Random(23)
    letters = "".join(draw.choices("abcdefghij ", k=150_000))
    words = [f"w{draw.randrange(50_000)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, f"{letters}#{letters}"), (2, " ".join(words)), (3, " ".join(words[:59_000]))], "doc_id long, text string")
    by = {r["doc_id"]: r for r in suffix.dedup(docs.where("doc_id = 1")).collect()}
    assert (by[1]["n_bytes"], by[1]["n_removed"], by[1]["n_spans"], bytes(by[1]["kept"])) == (300_001, 300_000, 2, b"#")
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in fmindex.dedup(docs.where("doc_id > 1")).collect()}
    assert cut == {2: (60_000, 0), 3: (59_000, 59_000)}
    votes = [0] * 64
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))
    assert simhash.fingerprint(simhash.shingle_hashes(" ".join(words))) == want


def test_kept_bytes_are_hashed(spark, tmp_path):
    rows = [(1, "x" * 500, "en", "s"), (2, "short", "en", "s")]
    got = {r["doc_id"]: r for r in suffix.query(spark, write(spark, tmp_path, rows)).collect()}
    assert got[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["kept_sha256"] == hashlib.sha256(b"short").hexdigest()
