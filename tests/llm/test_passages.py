import random

import numpy as np

from gleaner.llm import suffix


def test_passages_of_51_short_words_go_and_of_50_stay(spark):
    draw = random.Random(4)
    fresh = iter(range(10**6))

    def own(n):
        return " ".join(f"u{next(fresh)}" for _ in range(n))

    passage = [draw.choice("a be see dot even".split()) + draw.choice("xyz") for _ in range(51)]
    short = [draw.choice("fo go ho".split()) + draw.choice("pqr") for _ in range(50)]
    assert len(" ".join(passage)) < 300
    rows = []
    for i in range(6):
        text = " ".join(passage) if i % 2 else "\n ".join(passage)  # white space is no part of a word
        rows.append((i, f"{own(70)} {text} {own(70)}"))
    rows += [(10 + i, f"{own(60)} {' '.join(short)} {own(60)}") for i in range(3)]
    rows += [(20, "  " + " ".join(passage)), (21, None), (22, "é" * 300)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in suffix.strip_repeats(docs).collect()}
    for i, text in rows:
        words, left = (text or "").split(), (got[i]["text"] or "").split()
        want = words[:70] + words[121:] if i < 6 else [] if i == 20 else words
        assert left == want and got[i]["n_chars"] == len(got[i]["text"] or "")
    assert got[21]["text"] is None and got[11]["text"] == rows[7][1]


def test_words_repeat_where_all_pairs_do():
    draw = np.random.default_rng(6)
    bodies = [draw.integers(1, 3, n, dtype=np.uint64) * np.uint64(1 << 60) for n in (30, 80, 200, 7)]
    bodies.append(bodies[2][20:90].copy())
    got = suffix.repeated([b.tobytes() for b in bodies], np.ones(len(bodies)), 9, words=True)
    count = {}
    for b in bodies:
        for i in range(len(b) - 8):
            count[b[i : i + 9].tobytes()] = count.get(b[i : i + 9].tobytes(), 0) + 1
    assert [f.tolist() for f in got] == [[count[b[i : i + 9].tobytes()] > 1 for i in range(max(0, len(b) - 8))] for b in bodies]
