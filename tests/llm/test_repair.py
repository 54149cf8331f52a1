import hashlib
import itertools
import random
import re
import zlib

import pytest

from gleaner.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, m long, part int, at long, fault int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def written(rows):
    """Rows after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append(repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else 0 if body[-1] in ".!?" else repair.CUT)
        seen.add((role, text))
    return out


def every(rows, faults, inserts=3):
    """All edits of a conversation with at most so many inserts: (cost, letters, lines), the cheapest first."""
    best = None
    options = []
    for (_, _, role, text), f in zip(rows, faults, strict=True):
        more = 5 if f == repair.CUT else 0
        mine = [("D", 2, None)]
        if f not in (repair.BLANK, repair.DUPLICATE):
            mine += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        options.append(mine)
    extra = [("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]
    for n in range(inserts + 1):
        for at in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            slots = []
            for i in range(len(rows) + 1):
                slots += [extra] * at.count(i) + ([options[i]] if i < len(rows) else [])
            for path in itertools.product(*slots):
                if GOOD.match("".join((p[2][0] or "?")[:1] for p in path if p[2])):  # no role is no letter
                    found = (sum(p[1] for p in path), "".join(p[0] for p in path), [p[2] for p in path if p[2]])
                    best = min(best or found, found, key=lambda x: x[:2])
    return best


def brute(table, inserts=3):
    out = []
    for conv in sorted({r[0] for r in table}, key=repr):
        rows = written([r for r in table if r[0] == conv])
        faults = faults_of(rows)
        cost, audit, lines = every(rows, faults, inserts)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append(repr((conv, gaps, faults.count(1), faults.count(2), faults.count(3), wrong, cost, audit, digest)))
    return sorted(out)


def table(seed, conversations=40, most=5):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, ""], ["Yes.", "No!", "cut off", "", " \t", "Why? ", None, "é…", "Yes."]
    rows = []
    for c in range(conversations):
        conv = None if c == 7 else c
        for t in range(draw.randrange(1, most)):
            rows.append((conv, draw.choice([t, t, t, t * 3, None, -2]), draw.choice(roles), draw.choice(texts)))
    return rows + rows[:5]


def run(spark, tmp_path, rows, **params):
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted(repr(tuple(r)) for r in repair.query(spark, str(tmp_path), **params).collect())


@pytest.mark.parametrize("segment", [1, 2, repair.SEGMENT])
def test_against_all_edits(spark, tmp_path, segment):
    rows = table(segment)
    assert run(spark, tmp_path, rows, segment=segment) == brute(rows)


def test_the_machines_alone_against_all_edits():
    draw = random.Random(5)
    for _ in range(150):
        rows = [(0, 0, draw.choice(["user", "assistant", "system", "x"]), "t") for _ in range(draw.randrange(5))]
        faults = [draw.choice([0, 0, 1, 2, 3]) for _ in rows]
        assert repair.cheapest([(r[2][:1], f) for r, f in zip(rows, faults, strict=True)]) == every(rows, faults)[:2]


def test_one_conversation_over_all_ranges_and_segments(spark, tmp_path):
    """A conversation that holds most rows is cut; whole and cut give the same report."""
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["Yes.", f"no {t}", f"fine {t}."])) for t in range(400)]
    rows += [(1, 5, "user", "again.")] * 30 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho."), (0, 3, "user", "Hm.")]
    small, large = run(spark, tmp_path / "a", rows, segment=16), run(spark, tmp_path / "b", rows, segment=10**6)
    assert small == large
    mine = written([r for r in rows if r[0] == 1])
    cost, audit = repair.cheapest([(r[2][:1], f) for r, f in zip(mine, faults_of(mine), strict=True)])
    assert f", {cost}, '{audit}'" in " ".join(small)


def test_no_rows_after_damage_and_empty_tables(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, tmp_path, [(gone, 0, "user", "Hi.")]) == [repr((gone, 0, 0, 0, 0, 0, 0, "", nothing))]
    assert run(spark, tmp_path, []) == []


def test_wide_turns_and_long_texts(spark, tmp_path):
    rows = [(3, -(1 << 63), "user", "a" * 200_000 + "."), (3, (1 << 63) - 1, "assistant", "b.")]
    got = run(spark, tmp_path, rows)
    kept = written(rows)
    want = (1 << 63) - 1 if len({r[1] for r in kept}) == 2 else 0
    assert got[0].startswith(f"(3, {want}, ")
