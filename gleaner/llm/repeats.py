"""What exact substring dedup needs before its index: where windows can repeat, and their contexts.

A text is a sequence of units (bytes or words). Every window of ``width`` consecutive units has an anchor: the gram of
``gram`` units with the smallest hash in it, leftmost on ties. The anchor depends on the window's content alone, so equal
windows have equal anchors. Consecutive windows of one anchor form a block; its context is the stretch of units that
they cover. Two windows can only be equal if their blocks' anchors are, so

1. anchors seen once (for ``cross``: in one document) are dropped by a partial aggregate and a join,
2. equal contexts of an anchor are counted together (copies collapse here, before any text moves),
3. anchors left with several different contexts are residual: one copy of each context goes to the shard of its
   anchor, where an index decides window by window,
4. decisions go back to all occurrences, and the documents are rewritten.

An anchor with more than ``hot`` contexts is dealt over several shards by window hash: a context goes to the shards of
its own windows, and each shard decides only on its windows, so no shard grows with the frequency of one passage.
Joins read settled tables or fresh scans on both sides, so Spark can split a hot key's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lean, Scratch

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M1^k and its inverse's powers modulo 2^64 for k < n."""
    out = []
    for base in (int(M1), pow(int(M1), -1, 1 << 64)):
        p = np.full(max(n, 1), np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word (split at the six ASCII white-space bytes and at rows), and words before each row."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    at = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    start[at] |= solid[at]
    stop[at - 1] |= solid[at - 1]
    first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return first, end, np.searchsorted(first, offsets)


def word_codes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of every word's bytes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = end - first
    p, _ = powers(int(length.max()) + 1)
    at = np.repeat(first, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    rank = at - np.repeat(first, length)
    sums = np.add.reduceat(TABLE[data[at]] * p[rank], np.cumsum(length) - length)
    return mixed(sums + length.astype(np.uint64) * M2)


@dataclass(frozen=True)
class Blocks:
    row: np.ndarray  # which text
    lo: np.ndarray  # first window's start in it
    n: np.ndarray  # number of windows
    anchor: np.ndarray  # hash of the anchor gram
    context: np.ndarray  # hash of the covered units


def blocks(codes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> Blocks:
    """All blocks of texts whose unit codes stand one after the other, text t in bounds[t] to bounds[t + 1]."""
    n, none = len(codes), np.zeros(0, np.int64)
    if n < width:
        return Blocks(none, none, none, none, none)
    h = codes
    size, reach = 1, codes  # gram hashes by doubling: reach covers ``size`` units
    scale = int(M1)
    todo, h, done = gram, None, 0
    while todo:
        if todo & 1:
            if h is None:
                h, done = reach, size
            else:
                m = min(len(h), len(reach) - done)
                h = h[:m] + reach[done : done + m] * np.uint64(pow(scale, done, 1 << 64))
                done += size
        todo >>= 1
        if todo:
            reach = reach[:-size] + reach[size:] * np.uint64(pow(scale, size, 1 << 64))
            size *= 2
    h = mixed(h)[: n - gram + 1]
    bits = np.uint64(max(24, n.bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, least, w = 1, key, width - gram + 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - width + 1], least[w - span : w - span + n - width + 1])
    least = least[: n - width + 1]
    # Windows inside one text.
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    total = int(count.sum())
    if not total:
        return Blocks(none, none, none, none, none)
    row = np.repeat(np.arange(len(count)), count)
    start = np.repeat(bounds[:-1], count) + (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
    at = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, total))
    p, q = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * p[:n], dtype=np.uint64)))
    lo = start[head]
    covered = (sums[lo + many - 1 + width] - sums[lo]) * q[lo]
    return Blocks(
        row[head], lo - bounds[row[head]], many, h[at[head]].view(np.int64), (mixed(covered) ^ many.astype(np.uint64)).view(np.int64)
    )


#: Units whose blocks are found together: what bounds a worker's memory, however long a text is.
SLICE = 1 << 20


def sliced(units: np.ndarray, bounds: np.ndarray, kind: Kind, limit: int = SLICE):
    """Blocks of all texts, a slice of at most ``limit`` units at a time. A longer text is cut into pieces that overlap by
    a window less one unit; the cut may split a block in two, which changes no window's anchor."""
    part: list[tuple[int, int, int]] = []  # text, first unit, last unit of pieces that stand one after the other
    size = 0

    def flush():
        lo, hi = part[0][1], part[-1][2]
        x = blocks(kind.coded(units[lo:hi]), np.array([lo, *[p[2] for p in part]]) - lo, kind.width, kind.gram)
        text = np.array([p[0] for p in part])
        offset = np.array([p[1] - bounds[p[0]] for p in part])
        return Blocks(text[x.row], x.lo + offset[x.row], x.n, x.anchor, x.context)

    for t in range(len(bounds) - 1):
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        while True:
            stop = min(hi, lo + limit)
            if part and size + stop - lo > limit:
                yield flush()
                part, size = [], 0
            part.append((t, lo, stop))
            size += stop - lo
            if stop == hi:
                break
            yield flush()
            part, size = [], 0
            lo = stop - kind.width + 1
    if part:
        yield flush()


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of one sequence."""
    n = len(codes)
    p, q = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * p[:n], dtype=np.uint64)))
    return mixed((sums[width:] - sums[: n - width + 1]) * q[: n - width + 1])


@dataclass(frozen=True)
class Kind:
    """What differs between bytes and words."""

    width: int
    gram: int
    cross: bool  # only repeats in other documents count
    units: Callable  # (data, offsets) -> (units, bounds)
    coded: Callable  # units -> their 64-bit codes
    cut: Callable  # (text bytes, lists of lo and n) -> contexts as bytes
    codes: Callable  # context bytes -> unit codes
    hot: int = 2_000
    words: bool = False  # contexts are words' codes, eight bytes each, and ``suffix`` cuts whole words


#: Stands for a null doc_id where such rows take part.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, with_null: bool) -> tuple[DataFrame, list[str]]:
    """doc_id, a hash of the text where doc_ids repeat, and the text; and the names of the columns that tell rows of
    different content apart."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    if not with_null:
        ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.groupBy("doc_id").count().where("count > 1").head(1):
        return ids.select("doc_id", F.xxhash64("text").alias("th"), "text"), ["doc_id", "th"]
    return ids, ["doc_id"]


def find(scratch: Scratch, known: DataFrame, key: list[str], kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Occurrences (key, lo, n, anchor, context) of blocks whose anchor repeats, and the distinct contexts (anchor,
    context, n, copies, first: the smallest key that has it and where, k: contexts of the anchor)."""

    def scan(batches):
        for b in batches:
            for x in sliced(*kind.units(*text_buffer(b.column(len(key)))), kind):
                take = pa.array(x.row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(take) for k in range(len(key))), pa.array(x.lo, pa.int32()), pa.array(x.n, pa.int32()), pa.array(x.anchor, pa.int64()), pa.array(x.context, pa.int64())],
                    names=[*key, "lo", "n", "anchor", "context"],
                )

    found = known.mapInArrow(lean(scan), "".join(f"{k} long, " for k in key) + "lo int, n int, anchor long, context long")
    seen = found.groupBy("anchor")
    if kind.cross:
        again = seen.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    else:
        again = seen.agg(F.count("*").alias("a")).where("a > 1")
    again = scratch.settle(again.select("anchor"))
    spots = scratch.settle(found.join(again, "anchor"))
    distinct = scratch.settle(spots.groupBy("anchor", "context", "n").agg(F.count("*").alias("copies"), F.min(F.struct(*key, "lo")).alias("first")))
    many = scratch.settle(distinct.groupBy("anchor").agg(F.count("*").alias("k")))
    contexts = scratch.settle(distinct.join(many, "anchor"))
    scratch.drop(again, distinct, many)
    return spots, contexts


def shards(known: DataFrame, key: list[str], contexts: DataFrame, kind: Kind) -> DataFrame:
    """One copy of every residual context in the shards of its windows: anchor, shard, of (shards of the anchor),
    context, copies, low (smallest doc_id), body."""
    wanted = contexts.where("k > 1").groupBy(*[F.col(f"first.{k}").alias(k) for k in key]).agg(
        F.collect_list(F.struct("anchor", "context", "n", "copies", F.col("first.lo").alias("at"), "k")).alias("wanted")  # at most a document's blocks
    )

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for low, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (text or "").encode()
                bodies = kind.cut(raw, [w["at"] for w in wanted], [w["n"] for w in wanted])
                for w, body in zip(wanted, bodies, strict=True):
                    parts = -(-w["k"] // kind.hot)
                    places = [0] if parts == 1 else np.unique(window_hashes(kind.codes(body), kind.width) % np.uint64(parts)).tolist()
                    out += [(w["anchor"], int(s), parts, w["context"], w["copies"], low, body) for s in places]
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "shard", "of", "context", "copies", "low", "body"])

    # Of rows that are equal in every respect one is enough.
    some = known.join(wanted, key)
    some = some.dropDuplicates(key) if len(key) > 1 else some
    return some.select("doc_id", "text", "wanted").mapInArrow(lean(cut), "anchor long, shard int, of int, context long, copies long, low long, body binary")


def chunks(batches, budget: int):
    """Whole shards of a partition sorted by (anchor, shard), gathered up to ``budget`` bytes of bodies or one shard."""
    held, group, size, own, last = [], [], 0, 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:2] != last:
                if held and size + own > budget:
                    yield held
                    held, size = [], 0
                held += group
                size += own
                group, own, last = [], 0, row[:2]
            group.append(row)
            own += len(row[6])
    if held and size + own > budget:
        yield held
        held = []
    if held or group:
        yield held + group
