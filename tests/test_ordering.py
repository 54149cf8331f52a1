import random

from gleaner.operators import ordering, seeds


def test_positions_are_dense_and_in_order(spark):
    names = [f"id{i:05d}" for i in range(500)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, x int")
    for parts in (1, 7, 64):
        got = {r["id"]: r["row_index"] for r in ordering.dense_index(df, "id", parts=parts).collect()}
        assert got == {n: k for k, n in enumerate(sorted(names))}
    assert len(ordering.cuts(df, "id", 7)) == 6
    assert ordering.dense_index(df.limit(0), "id").collect() == []


def test_round_robin(spark):
    df = spark.range(50)
    assert {r["id"]: r["shard"] for r in seeds.shard(df, "id", 4).collect()} == {k: k % 4 for k in range(50)}
