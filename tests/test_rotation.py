import random

from gleaner.operators import presets as pr


def test_groups_avoid_wordings_of_earlier_groups(spark):
    draw = random.Random(2)
    rows = [("T", f"g{g:02d}", f"g{g:02d}-P{p}", f"P{p}", [f"words {draw.randrange(30)}"]) for g in range(12) for p in (1, 2, 3)]
    old = [("T", "x", "x", "P1", [f"words {k}"]) for k in (3, 7, 11)]
    schema = "template_id string, variable_group_id string, seed_id string, question_pattern_id string, user_turns array<string>"
    got = {r["variable_group_id"]: (r["seed_id"], r["reused"]) for r in pr.rotate_patterns(spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema)).collect()}
    used, want = {r[4][0] for r in old}, {}
    for k, g in enumerate(sorted({r[1] for r in rows})):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (int(r[3][1:]) - 1 - k) % 3)
        free = [r for r in order if r[4][0] not in used]
        pick = (free or order)[0]
        want[g] = (pick[2], not free)
        used.add(pick[4][0])
    assert got == want
