"""Top-k search against all pairs: repeated ids and vectors, several blocks and decks, columns of other names."""

import math
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import mtree


def brute(rows, k=20, every=20):
    x = [(i, [math.floor(64 * float(c)) for c in np.array(v, np.float32)]) for i, v in rows]
    inside = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = Counter()
    for q, v in x:
        if q % every == 0:
            best = sorted((-inside(sum(a * b for a, b in zip(v, w))), i) for i, w in x if i != q and len(w) == len(v))[:k]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    return want


def found(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_ids_and_vectors_that_repeat(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[5].tolist()), (0, x[0].tolist()), (0, x[0].tolist()), (20, x[20].tolist()), *[(20, (9 * x[20]).tolist())] * 30, *[(21, (9 * x[20]).tolist())] * 30]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(mtree.search(table)) == brute(rows)


@pytest.mark.parametrize("block, queries, least", [(50, 3, 10), (64, 1 << 18, 1000), (7, 2, 1)])
def test_blocks_and_decks_give_what_all_pairs_give(spark, block, queries, least):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.integers(-2, 3, 4) / 4).tolist()) for i in range(400)]
    table = spark.createDataFrame([(i, v, "x", 1, True) for i, v in rows], "vec_id long, embedding array<float>, block string, floor int, asks boolean")
    assert found(mtree.search(table, block=block, queries=queries, least=least)) == brute(rows)


@pytest.mark.parametrize("size", [1e5, 1e8, 1e12, 1e30])
def test_scores_are_exact_however_large_the_components(spark, size):
    draw = np.random.default_rng(9)
    rows = [(i, (draw.normal(size=5) * size * 10.0 ** draw.integers(-3, 1)).tolist()) for i in range(150)] + [(200 + i, [0.5, -0.5, 0.0, 1.0, 2.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(mtree.search(table, block=60, least=20)) == brute(rows)


def test_empty_vectors_meet_each_other(spark):
    rows = [(20, []), (3, []), (5, []), (40, [1.0]), (7, [2.0])]
    assert found(mtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute(rows)


def test_a_floor_and_the_own_id_lose_nothing():
    draw = np.random.default_rng(3)
    x = draw.integers(-9, 10, (500, 8))
    ids = np.concatenate([np.zeros(40, np.int64), np.arange(460)])
    tree = mtree.MTree(x, ids, float((x * x).sum(axis=1).max()), page=16)
    want = sorted(((-int(x[0] @ x[i]), int(ids[i])) for i in range(500) if ids[i] != 0))[:20]
    assert tree.search(x[0], 0) == [(-s, i) for s, i in want]
    assert tree.search(x[0], 0, floor=-want[-1][0]) == [(-s, i) for s, i in want]


def test_the_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert mtree.query(spark, str(tmp_path)).collect() == []
