import hashlib
import json
import random

from gleaner.operators import seeds as sd


def test_a_chain_of_groups_is_one_component(spark):
    rows = [(i, i + k) for i in range(320) for k in (0, 1)] + [(500, 900), (501, 900), (700, 901)]
    df = spark.createDataFrame(rows, "g long, q long")
    got = {r["g"]: r["component"] for r in sd.split_groups(df, "g", "q").collect()}
    assert got == {**{i: 0 for i in range(320)}, 500: 500, 501: 500, 700: 700}


def test_validation_is_what_the_sequential_rule_takes(spark):
    draw = random.Random(1)
    rows = [(f"g{i:02d}", f"q{draw.randrange(50)}", f"s{draw.randrange(3)}") for i in range(30) for _ in range(2)] + [("z", "own", "alone")]
    df = spark.createDataFrame(rows, "g string, q string, s string")
    got = {r["g"]: (r["component"], r["split"]) for r in sd.assign_splits(df, "g", "q", "s", "seed", 0.3).collect()}
    top = {g: c for g, (c, _) in got.items()}
    digest = lambda c: hashlib.sha256(json.dumps(["seed", c], separators=(",", ":")).encode()).hexdigest()
    taken = set()
    for s in sorted({r[2] for r in rows}):
        groups = {top[r[0]] for r in rows if r[2] == s}
        count = sum(r[2] == s and top[r[0]] in taken for r in rows)
        for c in sorted(groups, key=digest):
            if count >= 0.3 * sum(r[2] == s for r in rows) or len(groups - taken) <= 1:
                break
            if c not in taken:
                taken.add(c)
                count += sum(r[2] == s and top[r[0]] == c for r in rows)
    assert taken and {g for g, (c, x) in got.items() if x == "validation"} == {g for g, c in top.items() if c in taken}
