"""Phrases and similarities against plain definitions, and ranges of any size against one list."""

import hashlib
import random
from collections import Counter

import pytest

from gleaner.llm import lzprint


def phrases(text):
    """LZ78 by the book: a trie walked a character at a time."""
    trie, node, path, found = {}, None, "", set()
    node = trie
    for c in text:
        path += c
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            found.add(path)
            node, path = trie, ""
    return found | ({path} if path else set())


def test_phrases_are_those_of_the_definition():
    draw = random.Random(11)
    for n in (0, 1, 2, 50, 700):
        text = "".join(draw.choice("abé ") for _ in range(n))
        nxt = "".join(draw.choice("abcd") for _ in range(n // 2 + 3))
        assert lzprint.print_of(text) == lzprint.signature(phrases(text))
        a, e, edited = lzprint.print_pair(text, nxt)
        cut = n // 4
        assert edited == text[: n - cut] + nxt[:cut]
        assert (a, e) == (lzprint.signature(phrases(text)), lzprint.signature(phrases(edited)))


def test_likeness_follows_the_phrase_sets():
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 9))) for _ in range(300)]
    gaps = []
    for share in (0.0, 0.1, 0.3, 0.6, 0.9):
        a = " ".join(draw.choice(words) for _ in range(800))
        b = a[: int(len(a) * (1 - share))] + " ".join("".join(draw.choice("mnopqrst") for _ in range(6)) for _ in range(800))[: int(len(a) * share)]
        x, y = phrases(a), phrases(b)
        gaps.append(abs(lzprint.likeness(lzprint.print_of(a), lzprint.print_of(b)) - len(x & y) / len(x | y)))
    assert max(gaps) < 0.15


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_successors_across_ranges_and_copies(spark, ranges):
    draw = random.Random(13)
    rows = [(i, "".join(draw.choice("xyz ") for _ in range(draw.randrange(200)))) for i in range(60)]
    rows += [(7, None), (7, "other"), (30, "same")] + [(40, rows[40][1])] * 25 + [(None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, n int, part int, ghost string")
    got = lzprint.fingerprints(df, ranges).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    one_each = sorted(d for d, k in Counter(d for d, _ in rows if d is not None).items() if k == 1)
    text = dict(rows)
    by = {r["doc_id"]: r for r in got}
    for d in one_each:
        if d + 1 in one_each:  # its successor is known whatever the order of ties
            t, nxt = text[d] or "", text[d + 1] or ""
            cut = len(t) // 4
            assert by[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
            assert by[d]["near_next"] == lzprint.likeness(lzprint.print_of(t), lzprint.print_of(nxt))
    copies = [r for r in got if r["doc_id"] == 40]
    assert sum(r["near_next"] == 1.0 for r in copies) >= 25 and len({r["fingerprint"] for r in copies}) == 1
    ends = [r for r in got if r["doc_id"] == 59]  # the last is followed by the first: the rows without an id
    t = text[59]
    cut = len(t) // 4
    assert ends[0]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + "no id"[:cut]).encode()).hexdigest()


def test_the_smallest_id_is_no_null(spark):
    rows = [(-(1 << 63), "first of all"), (None, "no id"), (5, "five")]
    got = lzprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r["doc_id"]), r["n_chars"]) for r in got) == sorted((repr(d), len(t)) for d, t in rows)
    edited = {r["doc_id"]: r["edited_sha256"] for r in got}
    assert edited[None] == hashlib.sha256(("no id"[:4] + "f").encode()).hexdigest()  # a null id comes first, the smallest next
