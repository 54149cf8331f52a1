import random

import numpy as np

from gleaner.llm import nearcopies


def edited(words, draw, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"edit{draw.random()}"
    return words


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_down_to_four_fifths_go(spark):
    draw = random.Random(8)
    rows, kept = [], []
    for g in range(40):
        base = [f"t{g}w{draw.randrange(900)}" for _ in range(200)]
        at = draw.randrange(1, 4)  # each changed word changes five shingles of 196
        texts = [" ".join(base), " ".join(edited(base, draw, at))]
        assert jaccard(*texts) >= 0.8
        far = " ".join(edited(base, draw, 30))
        assert jaccard(texts[0], far) < 0.8
        rows += [(3 * g, texts[0]), (3 * g + 1, texts[1]), (3 * g + 2, far)]
        kept += [3 * g, 3 * g + 2]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in nearcopies.keep_one(docs).collect())
    assert got == sorted([*kept, 500, 503, -1])


def test_a_large_group_is_dealt_in_blocks_and_shared_ids_stay(spark):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    group = [" ".join(edited(base, draw, 1)) for _ in range(60)]
    other = [" ".join(f"o{i}x{k}" for k in range(50)) for i in range(5)]
    docs = spark.createDataFrame([(10 + i, t) for i, t in enumerate(group)] + [(10, t) for t in other] + [(10, other[0])], "doc_id long, text string")
    for block in (1024, 7):
        got = sorted(tuple(r) for r in nearcopies.keep_one(docs, block).collect())
        assert got == sorted([(10, group[0])] + [(10, t) for t in other])


def test_forest_links_what_all_pairs_link():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, (6, 100), dtype=np.uint64)
    sets = []
    for b in base:
        for n in (0, 5, 10, 20, 30):
            s = b.copy()
            s[draw.choice(100, n, replace=False)] = draw.integers(0, 1 << 63, n, dtype=np.uint64)
            sets.append(np.unique(s))

    def sim(a, b):
        return len(np.intersect1d(a, b)) / len(np.union1d(a, b))

    def count(pairs):
        label = np.arange(len(sets))
        for i, j in pairs:
            label[label == label[i]] = label[j]
        return sorted(np.unique(label, return_counts=True)[1].tolist())

    edges = nearcopies.forest(sets)
    assert all(sim(sets[i], sets[j]) >= 0.8 for i, j in edges)
    assert count(edges) == count([(i, j) for i in range(len(sets)) for j in range(i) if sim(sets[i], sets[j]) >= 0.8])
