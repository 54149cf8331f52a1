import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import fmindex, repeats, suffix


def brute_bytes(rows, width):
    seen = Counter(raw[i : i + width] for _, t in rows if (raw := (t or "").encode()) for i in range(len(raw) - width + 1))
    out = []
    for doc, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, width):
    low = {}
    for doc, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            if doc is not None:
                low[s] = min(low.get(s, doc), doc)
    out = []
    for doc, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and low[tuple(w[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    words = ["été", "of", "the", "a", "ß", "run", "北京", "x" * 30] + [f"w{i}" for i in range(40)]
    passages = [" ".join(draw.choices(words, k=draw.choice([12, 13, 14, 40, 120]))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(draw.choices(words, k=draw.choice([1, 5, 30]))) for _ in range(3)]
        for _ in range(draw.choice([0, 1, 2])):
            parts.insert(draw.randrange(4), draw.choice(passages))
        texts.append(draw.choice([" ", "\n", " "]).join(parts))
    texts += texts[:6] + [None, "", " ", "ab" * 400, "ab" * 401, "z" * 399, "z" * 1000, "w1 " * 60]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "clash") for d, t in rows], "doc_id long, text string, lo int, kept string")


def got_bytes(spark, rows, kind, memory=suffix.MEMORY):
    out = suffix.dedup(frame(spark, rows).select("doc_id", "text"), kind, memory).collect()
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytes_against_brute_force(spark, hot):
    kind = repeats.Kind(40, 8, False, suffix._units, suffix._coded, lambda raw, at, n: [raw[a : a + k - 1 + 40] for a, k in zip(at, n)], suffix._codes, hot)
    rows = corpus()
    assert order(got_bytes(spark, rows, kind, 1000 if hot == 2 else suffix.MEMORY)) == order(brute_bytes(rows, 40))
    # null and repeated ids
    odd = [(d if d % 3 else None, t) for d, t in rows[:30]] + rows[:4] + [(rows[0][0], rows[5][1])]
    assert order(got_bytes(spark, odd, kind)) == order(brute_bytes(odd, 40))


def test_bytes_at_full_width(spark):
    rows = corpus(4, 40)
    assert order(got_bytes(spark, rows, suffix.KIND)) == order(brute_bytes(rows, 400))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_words_against_brute_force(spark, hot):
    kind = repeats.Kind(13, 4, True, fmindex._units, fmindex._coded, fmindex._cut, fmindex._codes, hot)
    for rows in (corpus(2), [(d if d % 5 else None, t) for d, t in corpus(3)] + [(1, corpus(3)[8][1]), (1, "w1 " * 70)]):
        out = fmindex.dedup(frame(spark, rows), kind=kind).collect()
        assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == order(brute_words(rows, 13))


def test_empty_tables(spark):
    assert got_bytes(spark, [], suffix.KIND) == []
    assert fmindex.dedup(frame(spark, [])).collect() == []


def test_induced_sorting_gives_suffixes_and_common_prefixes():
    draw = np.random.default_rng(0)

    def common(a, b):
        k = 0
        while a[k : k + 1] == b[k : k + 1] and k < min(len(a), len(b)):
            k += 1
        return k

    for trial in range(300):
        n, k = int(draw.integers(1, 80)), int(draw.integers(1, 5))
        t = np.append(draw.integers(1, k + 1, n), 0).astype(np.uint16)
        if trial % 3 == 0:
            t = np.append(np.tile(draw.integers(1, k + 1, int(draw.integers(1, 5))), 20), 0).astype(np.uint16)
        store = suffix.Store(0 if trial % 2 else suffix.MEMORY)  # scratch files, or memory
        sa, lcp = suffix.suffix_array(t, int(t.max()) + 1, store, short=[0, 20, suffix.SHORT][trial % 3])
        x = t.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert sa.tolist() == want
        assert lcp.tolist() == [0] + [common(x[i:], x[j:]) for i, j in zip(want, want[1:])]


def test_blocks_hold_every_window_once_and_equal_windows_share_anchors():
    draw = np.random.default_rng(3)
    codes = repeats.TABLE[draw.integers(0, 3, 4000)]
    bounds = np.array([0, 0, 7, 1000, 1000, 2500, 4000])
    x = repeats.blocks(codes, bounds, 13, 4)
    windows = defaultdict(set)
    seen = set()
    for r, lo, n, a in zip(x.row, x.lo, x.n, x.anchor):
        for j in range(lo, lo + n):
            seen.add((r, j))
            windows[codes[bounds[r] + j : bounds[r] + j + 13].tobytes()].add(a)
    assert seen == {(r, j) for r in range(6) for j in range(bounds[r + 1] - bounds[r] - 12)}
    assert all(len(a) == 1 for a in windows.values())


def test_slices_cover_every_window_once_with_its_own_anchor():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 100, 900).astype(np.uint8)
    bounds = np.array([0, 5, 300, 300, 900])
    kind = repeats.Kind(40, 8, False, suffix._units, suffix._coded, None, None)
    whole = repeats.blocks(suffix._coded(data), bounds, 40, 8)
    anchors = {(r, j): a for r, lo, n, a in zip(whole.row, whole.lo, whole.n, whole.anchor) for j in range(lo, lo + n)}
    for limit in (50, 64, 301, 10_000):
        got = {}
        for x in repeats.sliced(data, bounds, kind, limit):
            for r, lo, n, a in zip(x.row, x.lo, x.n, x.anchor):
                for j in range(lo, lo + n):
                    assert (r, j) not in got
                    got[r, j] = a
        assert got == anchors
