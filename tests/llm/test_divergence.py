import random
import re
from collections import Counter, defaultdict

import pytest

from gleaner.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, p long"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, n = Counter(), defaultdict(Counter)
        for la, source, terms in docs:
            if la == lang:
                df.update(set(terms))
                n[source].update(terms)
        kept = sorted(t for t in df if df[t] >= 3)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in n.items()}
        whole = share(sum(n.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in n:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in n if o != s)
            terms = sorted((-f(p[s][t], whole[t]), t.encode(), t) for t in kept if n[s][t] and p[s][t] > whole[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked)}
    return out


def rows_of(seed, n=160):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "É", "\U0001f600b", "AB", "ab"]
    rows = []
    for i in range(n):
        lang, source = draw.choice(["en", "en", "de", None, ""]), draw.choice(["a", "a", "b", "ü", "", None, "empty"])
        text = None if draw.random() < 0.05 else draw.choice([" ", "-", "9"]).join(draw.choices(words, k=draw.randrange(30)))
        rows.append((i // 2, "" if source == "empty" else text, lang, source))
    return rows + rows[:9] + [(None, "AB\x00ab wa", "en", "lone"), (7, "wordless 12", "fr", "x"), (8, None, "fr", "y")]


@pytest.mark.parametrize("held", [5, 100_000])
def test_against_brute_force(spark, held):
    rows = rows_of(held)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = divergence.audit(df, held=held).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_top_cuts_each_group_and_ties_go_to_the_smaller_item(spark):
    rows = rows_of(3)
    got = divergence.audit(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), top=4).collect()
    assert {tuple(r) for r in got} == brute(rows, 4)


def test_many_sources_leave_the_table_of_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WIDTH", 3)
    rows = [(i, " ".join(["all"] * (i % 4 + 1) + [f"own{'abc'[i % 3]}"]), "en", f"s{i % 9}") for i in range(60)]
    # The tasks import the module anew, so what is tested here is the walk itself.
    walked = {}
    real = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    for r in divergence.audit(real).collect():
        walked[r["source"], r["part"], r["item"]] = r["value"]
    assert walked == {(s, part, item): v for _, s, part, item, v, _ in brute(rows)}


def test_long_texts_are_counted_in_slices_without_cutting_a_term():
    text = b"Word one\xc3\xa9" * 40 + b" " + b"x" * 100
    whole = text.translate(divergence._FOLD).split()
    for size in (1, 7, 64, 10**6):
        assert [t for part in divergence.slices(text, size) for t in part] == whole
    assert [t for part in divergence.slices(b"", 5) for t in part] == []


def test_shares_are_exact_beyond_a_long(spark):
    row = spark.range(1).select(divergence._share(divergence.F.lit(9_000_000_000_000_000_000), divergence.F.lit(9_100_000_000_000_000_000)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * 9_000_000_000_000_000_001 // 9_100_000_000_000_000_000


def test_records_are_sorted_by_a_hash_first_and_leave_the_jvm_without_what_only_orders_them(spark):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows_of(5)], SCHEMA)
    plan = divergence.cells(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [xxhash64(key#" in plan
    scan = plan[: plan.index("Sort [xxhash64(key#")].rsplit("MapInArrow", 1)[1]
    assert "Project [key#" in scan and "document#" not in scan


def test_keys_that_begin_alike_stay_apart(spark):
    texts = [f"{'common' * 5}{chr(97 + i % 5)} {'common' * 5}" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(i, t, "enc", "s0") for i, t in enumerate(texts)]
    got = divergence.audit(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)
