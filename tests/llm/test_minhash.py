import random

import numpy as np

from gleaner.llm import minhash
from gleaner.llm.common import Scratch

SCHEMA = "doc_id long, text string, n long, node string, root long, kept string, th long"


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, up = sets_of([r[1] for r in rows]), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return sorted(repr((r[0], len(sets[i]), low.get(top(i)), r[0] == low.get(top(i)))) for i, r in enumerate(rows))


def corpus(seed, n=50):
    draw = random.Random(seed)
    words = [f"W{i}é" for i in range(200)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 2, 3, 12, 40, 300]))) for _ in range(n)]
    for t in texts[: n // 2]:
        for edits in (1, 2, 4):
            w = t.split()
            for _ in range(edits):
                w[draw.randrange(len(w))] = draw.choice(words)
            texts.append(" ".join(w))
    # A chain: each text differs a little from the one before, so that its ends share little.
    chain = draw.choices(words, k=60)
    for k in range(25):
        texts.append(" ".join(chain))
        chain = [*chain[2:], f"c{k}", f"d{k}"]
    texts += texts[:6] + [None, "", " \t", None, "\x85\xa0", "one", "ONE", texts[9].lower()]
    rows = [(i if i % 17 != 3 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[0], (0, "same id, another text")]


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)
        for block in (minhash.BLOCK_BYTES, 500):
            got = sorted(repr(tuple(r)) for r in minhash.groups(docs, block).collect())
            assert got == brute(rows)


def test_links_that_miss_the_centre_are_found_inside_the_bucket(spark):
    """Three nodes of a bucket, of which only the two that aren't its centre are linked."""
    units = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 14, 16)]
    assert minhash.forest(units, [0, 1, 2]) == [(1, 2)] and minhash.forest(units, [0, 1, 1]) == []
    members = spark.createDataFrame([(5, node, 20, 3, 1) for node in (1, 2, 3)], "key long, node long, n long, size long, centre long")
    sets = spark.createDataFrame([(k + 1, bytearray(u.tobytes())) for k, u in enumerate(units)], "node long, units binary")
    roots = spark.createDataFrame([], "node long, root long")
    for block in (10**6, 200):
        got = {tuple(sorted((r["u"], r["v"]))) for r in minhash._inner(Scratch(spark), members, roots, sets, block).collect()}
        assert got == {(2, 3)}


def test_signatures_agree_as_often_as_the_sets_are_similar():
    draw = np.random.default_rng(4)
    for size in (6, 30, 400):
        agree = []
        for _ in range(60):
            pool = draw.integers(0, 1 << 63, size * 5 // 4, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:size]), np.unique(pool[len(pool) - size :])
            agree.append(np.mean(minhash.signature(a) == minhash.signature(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.05
    one = minhash.signature(np.array([7], np.uint64))
    assert (one == 7).all()


def test_a_third_of_all_rows_is_one_group(spark):
    rows = [(i, "the same words in every one of these texts " + (f"x{i % 5}" if i % 2 else "")) for i in range(300)] + [(1000 + i, f"lone {i} text") for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)
    got = sorted(repr(tuple(r)) for r in minhash.groups(docs).collect())
    assert got == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows if r[0] is not None], SCHEMA)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in minhash.groups(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
