"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily: the acceptor of a conversation's rows, an edit transducer (Keep, Rerole, Delete, Insert, with costs)
and the acceptor of the role grammar ``(s?(ua)+)?``. A state is a position and a state of the grammar, and only states that are
reached are made. Weights are (cost, label string), compared in that order; positions are a topological order, and inserts, which stay at
a position, only raise the cost. At one state strings of equal cost are never prefixes of each other (what is left
over would be inserts, which cost), so the smallest string stays the smallest whatever follows.

Rows are cut into ranges of the whole order (conversation, turn, role, text digest). What lies wholly in a range and has at most SEGMENT rows is
repaired in one pass. The other conversations, two a range and any that are very long, are cut into segments: a segment's weights
from each state of the grammar to each other are a 4 x 4 matrix over the same semiring, the product of a conversation's matrices in
order gives its cheapest string, and the rows take their letters from it. So no conversation is held by one task; only the digest of its
text, which is sequential by nature, is streamed by one.

Defined results: a null role or text is one blank, as is a null conv_id or turn in the text that is hashed to place the damage; a null
conv_id is a conversation of its own; null turns come first; rows of one turn are ordered by role, then by the MD5 digest of
their text; equal rows are rows of their own, of which all but the first are duplicates; a role is known by its first
letter, and one that is neither s, u nor a can't be kept; gaps beyond a long are the largest long; an empty table gives an empty result; other columns
of the table are never read.
"""

from __future__ import annotations

import hashlib
import os.path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, lean, partitions, tune

SEGMENT, SEGMENT_CHARS = 4096, 1 << 22
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The role grammar: state -> role initial -> state; FINAL states accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACE, _MOST = " \t\n\x0b\x0c\r", (1 << 63) - 1
_ROLE_TEXT = "array<struct<role:string,text:string>>"


# ---- the machines ----


def edits(initial: str, fault: int):
    """The edit transducer's arcs for a row: (letter, output or None, cost)."""
    yield "D", None, DELETE
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        yield "K", initial, more
        yield "R", "u", RELABEL + more
        yield "R", "a", RELABEL + more


def _relax(front: dict, state: int, weight: tuple) -> bool:
    if state in front and front[state] <= weight:
        return False
    front[state] = weight
    return True


def inserted(front: dict) -> dict:
    """The states reached at the same position by inserts."""
    todo = list(front)
    while todo:
        g = todo.pop()
        cost, label = front[g]
        todo += [h for h in (GRAMMAR[g].get(o) for o in NAMES) if h is not None and _relax(front, h, (cost + INSERT, label + "I"))]
    return front


def advanced(front: dict, initial: str, fault: int) -> dict:
    """The weights of the states behind one more row."""
    out: dict = {}
    for g, (cost, label) in front.items():
        for letter, o, more in edits(initial, fault):
            h = g if o is None else GRAMMAR[g].get(o)
            if h is not None:
                _relax(out, h, (cost + more, label + letter))
    return inserted(out)


def cheapest(rows) -> tuple[int, str]:
    """(cost, label string) of the shortest path over rows of (initial, fault)."""
    front = inserted({0: (0, "")})
    for initial, fault in rows:
        front = advanced(front, initial, fault)
    return min(front[g] for g in FINAL if g in front)


def expected(state: int) -> str:
    """The role that an inserted or renamed row has after a state."""
    return "a" if state == 2 else "u"


def replayed(state: int, letters: str, role: str, text: str):
    """(state, line) for each letter of a row; line is (role, text), or None where the row goes."""
    for letter in letters:
        if letter == "D":
            yield state, None
            continue
        o = role[:1] if letter == "K" else expected(state)
        state = GRAMMAR[state][o]
        yield state, (role if letter == "K" else NAMES[o], "" if letter == "I" else text)


def shape(text: str) -> int:
    """BLANK, CUT (its last character ends no sentence) or 0."""
    last = text.rstrip(_SPACE)[-1:]
    return BLANK if not last else 0 if last in ".!?" else CUT


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


# ---- one pass over ranges ----


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and m, how often the row stands there, after the damage that a row's CRC-32 places."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), r"[.!?]", "")).otherwise(blank("text"))
    return rows.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("m"))


def _condensed(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one, so that a row that a third of the table repeats doesn't stay in one range as often."""

    def walk(batches):
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(["conv_id", "turn", "role", "text"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["conv_id", "turn", "role", "text", "m"]).to_batches()

    return rows.mapInArrow(lean(walk), "conv_id long, turn long, role string, text string, m long")


def _whole(conv, lines: list) -> dict:
    """The report of a conversation of [turn, role, text, m] in order."""
    seen, faults, initials = set(), [], []
    count = [0, 0, 0, 0]
    for _, role, text, m in lines:
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        first = BLANK if shape(text) == BLANK else DUPLICATE if key in seen else shape(text)
        seen.add(key)
        mine = [first] + [BLANK if first == BLANK else DUPLICATE] * (m - 1)
        for f in mine:
            count[f] += 1
        faults += mine
        initials += [role[:1]] * m
    cost, audit = cheapest(zip(initials, faults, strict=True))
    flat = [(role, text) for _, role, text, m in lines for _ in range(m)]
    out, state, at = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else flat[at]
        at += letter != "I"
        state, line = next(replayed(state, letter, role, text))
        out += [line] if line else []
    turns = [t for t, *_ in lines if t is not None]
    gaps = min(_MOST, turns[-1] - turns[0] + 1 - len(set(turns))) if turns else 0
    wrong = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
    return {"conv_id": conv, "gaps": gaps, "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[CUT], "illegal": wrong, "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in out]}


_SCAN = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
         ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("part", pa.int32()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("m", pa.int64())]
_SCAN_DDL = f"conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired {_ROLE_TEXT}, part int, at long, turn long, role string, text string, m long"


def _scan(rows: DataFrame, segment: int) -> DataFrame:
    """Reports of conversations that lie wholly in a range, and the rows (part, at, turn, role, text, m) of all others."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "th"]
    keyed = rows.withColumn("th", F.md5(F.col("text").cast("binary")))
    ranged = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def walk(batches):
        part, conv, held, chars, sure, at, out, size = TaskContext.get().partitionId(), (), [], 0, False, 0, [], 0

        def loose():
            nonlocal at
            for turn, role, text, m in held:
                yield {"conv_id": conv, "part": part, "at": at, "turn": turn, "role": role, "text": text, "m": m}
                at += 1

        def emit():
            return pa.RecordBatch.from_pylist(out, schema=pa.schema(_SCAN))

        for b in batches:
            for this, turn, role, text, m in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                if held and this == conv and held[-1][:3] == [turn, role, text]:
                    held[-1][3] += m
                    chars += m
                    continue
                if this != conv:
                    if held:
                        out += [_whole(conv, held)] if sure else loose()
                    sure, conv, held, chars = conv != (), this, [], 0  # a range's first conversation may have begun before
                elif len(held) >= segment or chars > SEGMENT_CHARS:
                    sure = False
                    out += loose()
                    held, chars = [], 0
                held.append([turn, role, text, m])
                chars += len(text) + m
                size += len(text)
                if len(out) > 1000 or size > SEGMENT_CHARS:
                    yield emit()
                    out, size = [], 0
        out += loose()  # a range's last one may go on
        yield emit()

    return ranged.select("conv_id", "turn", "role", "text", "m").mapInArrow(lean(walk), _SCAN_DDL)


# ---- conversations across ranges ----


def _matrices(rows: DataFrame, segment: int) -> DataFrame:
    """A row a segment: its rows' first place and numbers, counts, edges, and the matrix of weights (a cost of -1: no path)."""
    schema = "conv_id long, part int, segment long, at long, ms array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, costs array<long>, labels array<string>"

    def walk(batches):
        name, held = None, []

        def close():
            count, wrong, initials, faults = [0, 0, 0, 0], 0, [], []
            for _, _, role, fault, leads, m in held:
                first = BLANK if fault == BLANK else fault if leads else DUPLICATE
                mine = [first] + [BLANK if fault == BLANK else DUPLICATE] * (m - 1)
                for f in mine:
                    count[f] += 1
                faults += mine
                initials += [role] * m
            wrong = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
            costs, labels = [], []
            for g in range(len(GRAMMAR)):
                front = inserted({g: (0, "")})
                for initial, fault in zip(initials, faults, strict=True):
                    front = advanced(front, initial, fault)
                for h in range(len(GRAMMAR)):
                    cost, label = front.get(h, (-1, ""))
                    costs.append(cost)
                    labels.append(label)
            turns = [t for _, t, *_ in held if t is not None]
            conv, part, seg = name
            row = {"conv_id": conv, "part": part, "segment": seg, "at": held[0][0], "ms": [h[-1] for h in held], "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[CUT], "illegal": wrong,
                   "first": initials[0], "last": initials[-1], "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "costs": costs, "labels": labels}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(f, pa.int32() if f == "part" else pa.list_(pa.int64()) if f in ("ms", "costs") else pa.list_(pa.string()) if f == "labels" else pa.string() if f in ("first", "last") else pa.int64()) for f in row]))

        for b in batches:
            for conv, part, seg, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, part, seg) != name:
                    if held:
                        yield close()
                    name, held = (conv, part, seg), []
                held.append(row)
        if held:
            yield close()

    rows = rows.select("conv_id", "part", F.expr(f"at div {segment}").alias("segment"), "at", "turn", F.substring("role", 1, 1).alias("role"), "fault", "leads", "m")
    order = ["conv_id", "part", "segment", "at"]
    return rows.repartition(partitions(rows.sparkSession), "part", "segment", "conv_id").sortWithinPartitions(*order).mapInArrow(lean(walk), schema)


def _products(segments: DataFrame) -> DataFrame:
    """A report a conversation (part is null), and the letters of each row (part, at) with the grammar's state before it."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    types = {"conv_id": pa.int64(), **dict.fromkeys(names, pa.int64()), "audit": pa.string(), "part": pa.int32(), "at": pa.int64(), "letters": pa.string()}

    def walk(batches):
        conv, held, front, done = (), [], {}, []

        def close():
            front_, s = {g: w for g, w in front.items() if g in FINAL}, dict.fromkeys(names, 0)
            cost, label = min(front_.values())
            audit = "".join(done) + label
            last, turns, low, high, before = None, 0, None, None, None
            for r in held:
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    s[c] += r[c]
                s["illegal"] += last is not None and not legal(last, r["first"])
                last = r["last"]
                if r["low"] is not None:
                    turns += r["turns"] - (high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
            s["gaps"], s["cost"] = min(_MOST, high - low + 1 - turns) if low is not None else 0, cost
            out, at = [{"conv_id": conv, **s, "audit": audit}], 0
            for k, r in enumerate(held):
                for i, m in enumerate(r["ms"]):
                    end, left = at, m
                    while left:  # up to the row's last letter; a conversation's last row takes what follows
                        left -= audit[end] != "I"
                        end += 1
                    if k == len(held) - 1 and i == len(r["ms"]) - 1:
                        end = len(audit)
                    out.append({"conv_id": conv, "part": r["part"], "at": r["at"] + i, "letters": audit[at:end]})
                    at = end
            for a in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[a : a + 10_000], schema=pa.schema(list(types.items())))

        for b in batches:
            for r in b.to_pylist():
                if r["conv_id"] != conv:
                    if held:
                        yield from close()
                    conv, held, front, done = r["conv_id"], [], {0: (0, "")}, []
                new: dict = {}
                for g, (cost, label) in front.items():
                    for h in range(len(GRAMMAR)):
                        more = r["costs"][len(GRAMMAR) * g + h]
                        if more >= 0:
                            _relax(new, h, (cost + more, label + r["labels"][len(GRAMMAR) * g + h]))
                common = len(os.path.commonprefix([label for _, label in new.values()]))  # all paths begin so, whatever follows
                done.append(next(iter(new.values()))[1][:common])
                front = {g: (cost, label[common:]) for g, (cost, label) in new.items()}
                held.append({k: v for k, v in r.items() if k not in ("costs", "labels")})
        if held:
            yield from close()

    ordered = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return ordered.mapInArrow(lean(walk), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part int, at long, letters string")


def _replay(rows: DataFrame) -> DataFrame:
    """conv_id, role and text of the repaired lines, in order within a partition, from rows with their letters."""

    def walk(batches):
        conv, state = (), 0
        for b in batches:
            out: list = []
            for this, role, text, letters in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state = state if this == conv else 0
                conv = this
                for state, line in replayed(state, letters, role, text):
                    if line:
                        out.append((this, *line))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["conv_id", "role", "text"])

    order = ["conv_id", "part", "at"]
    ordered = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text", "letters").mapInArrow(lean(walk), "conv_id long, role string, text string")


def _hashed(lines: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of ``role:text`` lines that come in order, streamed."""

    def walk(batches):
        conv, h, out = (), None, []
        for b in batches:
            for this, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this != conv:
                    out += [(conv, h.hexdigest())] if h else []
                    conv, h = this, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        out += [(conv, h.hexdigest())] if h else []
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["conv_id", "digest"])

    return lines.mapInArrow(lean(walk), "conv_id long, digest string")


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, m): reports of conversations within a range with their repaired lines as an array, reports
    of the others, and the others' repaired lines (conv_id, role, text), which stand in order within a partition."""
    scratch = Scratch(tune(rows.sparkSession))
    scanned = scratch.settle(_scan(_condensed(rows), segment))
    report = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = scanned.where("part IS NULL").select(*report, "repaired")
    loose = scanned.where("part IS NOT NULL").select("conv_id", "part", "at", "turn", "role", "text", "m")
    marked = loose.withColumn("th", F.md5(F.col("text").cast("binary")))
    firsts = marked.groupBy("conv_id", "role", "th").agg(F.min(F.struct("part", "at")).alias("lead"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "th")]
    space = r"[\x20\x09-\x0D]*$"
    last = F.right(F.regexp_replace("text", space, ""), F.lit(1))
    narrow = marked.withColumn("fault", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(CUT)).drop("text")
    narrow = narrow.alias("a").join(firsts.alias("b"), same[0] & same[1] & same[2]).select("a.*", (F.col("b.lead") == F.struct("a.part", "a.at")).alias("leads"))
    found = scratch.settle(_products(scratch.settle(_matrices(narrow, segment))))
    letters = found.where("part IS NOT NULL").select("part", "at", "letters")
    return whole, found.where("part IS NULL").select(*report), _replay(loose.join(letters, ["part", "at"]))


def query(spark: SparkSession, sf_dir: str, segment: int = SEGMENT) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations")
    whole, others, lines = repair(damaged(rows), segment)
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    digests = _hashed(lines).withColumnRenamed("conv_id", "_conv")
    others = others.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    done = whole.withColumn("digest", F.sha2(text, 256)).drop("repaired").unionByName(others)
    ids = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    out = ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", nothing).alias("repaired_sha256"))


def _step() -> str:
    """The SQL of one row's arcs: weights v0 to v3 become w0 to w3, then x0 to x3 by inserts."""
    arc = lambda v, letter, cost, when="TRUE": f"CASE WHEN {v} IS NOT NULL AND {when} THEN {{'c': {v}.c + {cost}, 's': {v}.s || '{letter}'}} END"
    least = lambda *arcs: f"list_min([{', '.join(arcs)}])"
    free, more = "fault NOT IN (1, 2)", "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    keep = lambda v, o: arc(v, "K", more, f"{free} AND initial = '{o}'")
    rename = lambda v: arc(v, "R", f"1 + {more}", free)
    drop = lambda v: arc(v, "D", 2)
    rows = [
        least(drop("v0")), least(drop("v1"), keep("v0", "s")), least(drop("v2"), *[f(v) for v in ("v0", "v1", "v3") for f in (lambda v: keep(v, "u"), rename)]),
        least(drop("v3"), keep("v2", "a"), rename("v2"))]
    return ", ".join(f"{r} AS w{k}" for k, r in enumerate(rows))


def _inserts(v: str) -> list[str]:
    arc = lambda k, n: f"CASE WHEN {v}{k} IS NOT NULL THEN {{'c': {v}{k}.c + {5 * n}, 's': {v}{k}.s || '{'I' * n}'}} END"
    return [f"{v}0", f"{v}1", f"list_min([{v}2, {arc(0, 1)}, {arc(1, 1)}, {arc(3, 1)}])", f"list_min([{v}3, {arc(2, 1)}, {arc(0, 2)}, {arc(1, 2)}])"]


#: A crossing of the grammar by recursion over positions, with CRC-32 computed bit by bit.
SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE kind <> 0
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, left(role, 1) AS initial FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM p
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal,
         list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts FROM f GROUP BY conv_id
), dp(conv_id, pos, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0::BIGINT, 's': ''}, NULL::STRUCT(c BIGINT, s VARCHAR), {'c': 5::BIGINT, 's': 'I'}, {'c': 10::BIGINT, 's': 'II'} FROM n
  UNION ALL
  SELECT conv_id, pos, %s FROM (SELECT dp.conv_id, f.pos, %s FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1)
), best AS (
  SELECT n.*, list_min([v0, v3]) AS b FROM n JOIN dp ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.pos = n.n
), r AS (
  SELECT *, b.s AS audit, replace(b.s, 'D', '')[1] = 'K' AND roles[strpos(replace(b.s, 'I', ''), 'K')][1] = 's' AS system FROM best
), lines AS (
  SELECT conv_id, list_transform(range(1, len(audit) + 1), lambda j: CASE WHEN audit[j] = 'D' THEN NULL ELSE
    (CASE WHEN audit[j] = 'K' THEN roles[len(replace(audit[1:j], 'I', ''))] WHEN (len(replace(audit[1:j], 'D', '')) - system::INT) %% 2 = 1 THEN 'user' ELSE 'assistant' END)
    || ':' || CASE WHEN audit[j] = 'I' THEN '' ELSE texts[len(replace(audit[1:j], 'I', ''))] END END) AS l FROM r
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(r.b.c, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(list_filter(l, lambda x: x IS NOT NULL), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("%s", "{}").replace("%% 2", "% 2")
SQL = SQL.replace("{}", ", ".join(f"{x} AS v{k}" for k, x in enumerate(_inserts("w"))), 1).replace("{}", _step(), 1)
