import random

import numpy as np
import xxhash

from gleaner.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def components(ids, fps):
    up = {i: i for i in range(len(fps))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                up[top(i)] = top(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def run(spark, rows, **params):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.groups(docs, **params).collect())


def test_against_all_pairs(spark):
    draw = random.Random(3)
    words = [f"W{i}é" for i in range(30)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 2, 5, 300]))) for _ in range(60)]
    for t in texts[:20]:
        w = t.split()
        w[draw.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += texts[:5] + [None, "", " \t\n", "\x85\xa0", texts[7].lower()]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    fps = brute(texts)
    want = components([r[0] for r in rows], fps)
    want = sorted((r[0] is None, r[0] or 0, int(np.uint64(f).astype(np.int64)), want[i]) for i, (r, f) in enumerate(zip(rows, fps)))
    assert run(spark, rows) == want
    assert run(spark, rows, bands=4, block=3) == want  # buckets of several blocks


def test_forest_links_what_all_pairs_link():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 6)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ f for f in flips.T], base[:20] ^ flips[:20, 0] ^ flips[:20, 1] ^ flips[:20, 2]]))
    for radius in (0, 1, 2, 3):
        edges = simhash.forest(fps, radius)
        assert all(bin(int(fps[i] ^ fps[j])).count("1") <= radius for i, j in edges)
        links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= radius]

        def count(pairs):
            label = np.arange(len(fps))
            for i, j in pairs:
                label[label == label[i]] = label[j]
            return sorted(np.unique(label, return_counts=True)[1].tolist())

        assert count(edges) == count(links)


def test_chain_of_links_is_one_component(spark):
    from gleaner.llm.common import Scratch, components as cc

    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in cc(Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def test_empty_table_and_keep_one(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (4, "other words here now")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(docs).collect()) == [0, 1, 4]


def test_keep_one_keeps_a_row_of_each_component_under_a_shared_doc_id(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    rows = [(7, t) for t in texts[:4]] + [(7, texts[4]), (5, texts[4]), (7, texts[4]), (9, texts[5]), (9, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(7, t) for t in texts[:4]] + [(5, texts[4]), (9, texts[5])])
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == want
