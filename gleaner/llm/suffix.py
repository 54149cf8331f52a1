"""Suffix-array dedup by external induced sorting.

Units are bytes. Every byte covered by a string of WIDTH bytes that also starts anywhere else in the corpus is removed.
Candidate contexts come from ``repeats``; a context that occurs twice repeats as a whole, and the rest are decided by a
suffix array of their shard.

Sorting: suffixes are typed S or L, the leftmost S ones (LMS) are sorted by recursion on the string of their names, and
all others are induced from them. The queues of the induction are monotone priority queues: one first-in-first-out
bucket per symbol, in symbol order, which carry tuples of a suffix and its common prefix with the one before, in step
through whole batches of buckets (a batch ends before the first bucket that still waits for an entry of the batch itself).
Recursion hands up the order and the common prefixes of the LMS suffixes, and induction extends both to all suffixes. The
text, queues and output lie in memory-mapped scratch files once they exceed ``memory`` bytes. Bodies, types, names, flags and
range minima stay in memory, so a shard must fit there; shards are gathered to CHUNK bytes. Scratch files belong to one task, like Spark's own spills, and go with it.

Defined results: a null text is empty; null doc_ids take part; rows that share doc_id, or are equal, are different
places, so equal rows of WIDTH bytes remove each other; overlaps count; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import repeats
from gleaner.llm.common import documents, lean, partitions, tune, Scratch

WIDTH, GRAM, CHUNK, MEMORY, SHORT = 400, 64, 3 << 19, 256 << 20, 16_384


def _units(data: np.ndarray, offsets: np.ndarray):
    return data, offsets


def _coded(data: np.ndarray) -> np.ndarray:
    return repeats.TABLE[data]


def _cut(raw: bytes, at: list[int], n: list[int]) -> list[bytes]:
    return [raw[a : a + k - 1 + WIDTH] for a, k in zip(at, n, strict=True)]


def _codes(body: bytes) -> np.ndarray:
    return repeats.TABLE[np.frombuffer(body, np.uint8)]


KIND = repeats.Kind(WIDTH, GRAM, False, _units, _coded, _cut, _codes)

#: The pipeline's stage: passages of over 50 words, whatever the length of the words.
PASSAGE, PASSAGE_GRAM = 51, 8


def _word_units(data: np.ndarray, offsets: np.ndarray):
    first, end, bounds = repeats.words_in(data, offsets)
    return repeats.word_codes(data, first, end), bounds


def _word_coded(codes: np.ndarray) -> np.ndarray:
    return codes


def _word_cut(raw: bytes, at: list[int], n: list[int]) -> list[bytes]:
    data = np.frombuffer(raw, np.uint8)
    codes, _ = _word_units(data, np.array([0, len(data)]))
    return [codes[a : a + k - 1 + PASSAGE].astype("<u8").tobytes() for a, k in zip(at, n, strict=True)]


def _word_codes(body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<u8")


WORDS = repeats.Kind(PASSAGE, PASSAGE_GRAM, False, _word_units, _word_coded, _word_cut, _word_codes, words=True)


class Store:
    """Arrays in memory, or in scratch files once they would take more than ``memory`` bytes together."""

    def __init__(self, memory: int = MEMORY):
        self.left, self.files = memory, []

    def array(self, n: int, dtype, fill: int) -> np.ndarray:
        size = int(n) * np.dtype(dtype).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.full(n, fill, dtype)
        f = tempfile.TemporaryFile()  # unlinked at once: it goes with the task
        self.files.append(f)
        out = np.memmap(f, dtype, "w+", shape=(n,))
        out[:] = fill
        return out


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """True where a suffix is smaller than the next (type S; the last symbol is the smallest and only one), how often its
    first symbol stands there in a row, and how often in a row before it."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32))).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    kind = np.ones(n, bool)
    kind[:-1] = np.where(nxt < n - 1, step[np.minimum(nxt, n - 2)] > 0, False)
    run = np.ones(n, np.int32)
    run[:-1] = np.minimum(nxt, n - 1) - np.arange(n - 1) + 1
    begin = np.zeros(n, np.int32)
    begin[1:] = np.where(step != 0, np.arange(1, n, dtype=np.int32), 0)
    return kind, run, np.arange(n, dtype=np.int32) - np.maximum.accumulate(begin)


class _Minima:
    """Range minima of one array by a sparse table."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= half:
                break
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of each stretch lo to hi - 1 (not empty)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in range(int(level.max()) + 1 if len(level) else 0):
            m = np.flatnonzero(level == k)
            if len(m):
                table = self.levels[k]
                out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k)])
        return out


class _Queue:
    """The buckets of one type: a first-in-first-out list of (suffix, common prefix with the one before) per symbol, one
    list after the other in two arrays."""

    def __init__(self, counts: np.ndarray, store: Store, measured: bool):
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.free = self.start[:-1].copy()
        self.items = store.array(int(self.start[-1]), np.int32, -1)
        self.common = store.array(int(self.start[-1]), np.int32, 0) if measured else None

    def push(self, positions: np.ndarray, symbols: np.ndarray, place: np.ndarray, between) -> None:
        """Appends suffixes in order. place: where each one's successor stands in the batch; between: the batch's minima.
        What a bucket got in an earlier batch begins with another second symbol."""
        order = np.argsort(symbols, kind="stable")
        p, c = positions[order], symbols[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        count = np.diff(np.append(head, len(c)))
        slot = self.free[c] + np.arange(len(c)) - np.repeat(head, count)
        self.items[slot] = p
        if self.common is not None:
            at, common = place[order], np.ones(len(c), np.int32)
            later = np.ones(len(c), bool)
            later[head] = False
            k = np.flatnonzero(later)
            common[k] += between(at[k - 1] + 1, at[k] + 1)
            self.common[slot] = common
        self.free[c[head]] += count

    def complete(self, a: int, back: np.ndarray) -> None:
        """Appends to bucket a the suffixes whose successor is in it as well: once more the symbol before all entries that
        have it there, then twice, and so on. back: how often a suffix's symbol stands before it in a row."""
        lo, hi, stop = self.start[a], self.free[a], self.start[a + 1]
        first = np.array(self.items[lo:hi])
        depth = back[first]
        k = np.repeat(np.arange(len(first)), depth)
        turn = np.arange(len(k)) - np.repeat(np.cumsum(depth) - depth, depth) + 1
        order = np.lexsort((k, turn))
        k, turn = k[order], turn[order]
        self.items[hi:stop] = first[k] - turn
        if self.common is not None:
            own = np.array(self.common[lo:hi])
            common = turn.astype(np.int32)  # a turn's first entry and the turn before differ after so many symbols
            same = np.flatnonzero(turn[1:] == turn[:-1]) + 1
            if len(same):
                common[same] += _Minima(own).between(k[same - 1] + 1, k[same] + 1)
            self.common[hi:stop] = common
        self.free[a] = stop


def _induce(t, s_type, run, back, seeds, seed_common, seeds_start, sigma, queue, descending: bool) -> None:
    """Empties the buckets in symbol order into ``queue``. Seeds of bucket c, seeds[seeds_start[c]:seeds_start[c + 1]], follow
    the queue's own entries of c. Ascending for type L; for type S symbols and orders are mirrored by the caller.

    The common prefix of two emitted suffixes of a bucket is one more than the smallest among what was processed from the
    one's successor to the other's; between two buckets it is nothing.
    """
    measured = queue.common is not None

    def seed_values(a: int, b: int) -> np.ndarray:
        """Common prefixes of the seeds of buckets a to b - 1 with what is processed before them."""
        lo, hi = seeds_start[a], seeds_start[b]
        out = np.array(seed_common[lo:hi])
        some = np.flatnonzero(seed_counts[a:b])
        first, own = seeds_start[a:b][some] - lo, queue.free[a:b][some]
        # The last of type L and the first of type S in a bucket agree as far as the shorter of their runs of its symbol.
        out[first] = 0
        k = np.flatnonzero(own > queue.start[a:b][some])
        out[first[k]] = np.minimum(run[queue.items[own[k] - 1]], run[seeds[lo + first[k]]])
        return out

    own_counts, seed_counts = np.diff(queue.start), np.diff(seeds_start)
    a, step = 0, 64
    while a < sigma:
        b = min(a + step, sigma)
        waiting = np.flatnonzero(queue.free[a:b] < queue.start[a + 1 : b + 1])
        if len(waiting) and waiting[0] == 0:
            queue.complete(a, back)  # all that is still to come feeds on the bucket itself
            continue
        step *= 2
        if len(waiting):
            b = a + int(waiting[0])
            step = max(64, b - a)
        lo, hi = queue.start[a], queue.start[b]
        both = np.concatenate([queue.items[lo:hi], seeds[seeds_start[a] : seeds_start[b]]])
        common = None
        if measured:
            mine = np.array(queue.common[lo:hi])
            mine[(queue.start[a:b] - lo)[own_counts[a:b] > 0]] = 0
            common = np.concatenate([mine, seed_values(a, b)])
        if b - a > 1 and lo < hi < lo + len(both):
            key = np.concatenate([2 * np.repeat(np.arange(a, b), own_counts[a:b]), 2 * np.repeat(np.arange(a, b), seed_counts[a:b]) + 1])
            order = np.argsort(key, kind="stable")
            both = both[order]
            common = common[order] if measured else None
        q = both - 1
        k = np.flatnonzero((both > 0) & (s_type[q] == descending) & (t[q] != t[both]))
        if len(k):
            c = t[q[k]]
            queue.push(q[k], (sigma - 1 - c) if descending else c, k, _Minima(common).between if measured else None)
        a = b


def _sorted_by_induction(t, s_type, run, back, lms, lms_common, sigma, store) -> tuple[np.ndarray, np.ndarray | None]:
    """The order of all suffixes that follows from the given order of the LMS suffixes, and each one's common prefix with
    the one before (if those of the LMS suffixes are given)."""
    measured = lms_common is not None
    counts_l, counts_s = np.bincount(t[~s_type], minlength=sigma), np.bincount(t[s_type], minlength=sigma)
    left = _Queue(counts_l, store, measured)
    symbol = t[lms]
    order = np.argsort(symbol, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=sigma))))
    _induce(t, s_type, run, back, lms[order], lms_common[order] if measured else None, start, sigma, left, False)
    # Type S from the back: symbols mirrored, L entries of a bucket as seeds in reverse order.
    right = _Queue(counts_s[::-1], store, measured)
    right.items[-1], right.free[-1] = len(t) - 1, right.start[-1]  # the last symbol follows from nothing
    mirrored = np.concatenate(([0], np.cumsum(counts_l[::-1])))
    back_common = np.concatenate(([0], left.common[::-1][:-1])).astype(np.int32) if measured and len(left.items) else np.zeros(0, np.int32)
    _induce(t, s_type, run, back, left.items[::-1], back_common if measured else None, mirrored, sigma, right, True)
    out = store.array(len(t), np.int32, -1)
    begin = np.concatenate(([0], np.cumsum(counts_l + counts_s)))[:-1]
    c_l = np.repeat(np.arange(sigma), counts_l)
    c_s = np.repeat(np.arange(sigma), counts_s)
    at_l = begin[c_l] + np.arange(len(left.items)) - left.start[c_l]
    s_start = np.concatenate(([0], np.cumsum(counts_s)))
    at_s = begin[c_s] + counts_l[c_s] + np.arange(len(right.items)) - s_start[c_s]
    out[at_l], out[at_s] = left.items, right.items[::-1]
    if not measured:
        return out, None
    common = store.array(len(t), np.int32, 0)
    common[at_l] = left.common
    common[at_s] = np.concatenate(([0], right.common[::-1][:-1]))
    some = np.flatnonzero(counts_s)
    edge = begin[some] + counts_l[some]  # first of type S in a bucket
    both = counts_l[some] > 0
    common[edge] = np.where(both, np.minimum(run[out[np.maximum(edge - 1, 0)]], run[out[edge]]), 0)
    common[begin[np.flatnonzero(counts_l + counts_s)]] = 0
    return out, common


def _agree(t, s_type, run, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes a and b, which agree in ``known`` symbols and differ in symbol or type before the end
    of the next LMS substring."""
    out = known.astype(np.int32)
    alive = np.arange(len(a))
    while len(alive):
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        same, kind = t[x] == t[y], s_type[x] == s_type[y]
        stop = same & ~kind  # equal symbols of other types: they agree to the end of the shorter run
        out[alive[stop]] += np.minimum(run[x[stop]], run[y[stop]])
        alive = alive[same & kind]
        out[alive] += 1
    return out


def _short(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion: a string of few symbols is sorted by doubling, its common prefixes found one by one."""
    n, span = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while rank.max() < n - 1:
        nxt = np.full(n, -1, np.int64)
        nxt[:-span] = rank[span:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        span *= 2
    common, k = [0] * n, 0
    text, places, before = t.tolist(), rank.tolist(), order.tolist()
    for i, r in enumerate(places):  # Kasai et al., 2001
        if r == 0:
            k = 0
            continue
        j = before[r - 1]
        while text[i + k] == text[j + k]:  # the last symbol is unique: no end is passed
            k += 1
        common[r] = k
        k = max(0, k - 1)
    return order.astype(np.int32), np.array(common, np.int32)


def suffix_array(t: np.ndarray, sigma: int, store: Store | None = None, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a string of symbols below sigma whose last symbol is 0 and occurs once, and each suffix's common
    prefix with the one before it."""
    store = store or Store()
    n = len(t)
    if n <= max(1, short):
        return _short(t)
    s_type, run, back = _types(t)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    rough, _ = _sorted_by_induction(t, s_type, run, back, lms, None, sigma, store)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = np.array(rough[is_lms[rough]])
    del rough
    # Names: equal LMS substrings (up to the next LMS position, itself included) share one.
    end = np.full(n, n, np.int32)
    end[lms[:-1]] = lms[1:]
    end[lms[-1]] = lms[-1]
    size = end[order] - order
    del end
    differ = np.ones(len(order), bool)
    differ[1:] = size[1:] != size[:-1]
    alive, k = np.flatnonzero(~differ), 0
    while len(alive):
        a, b = order[alive] + k, order[alive - 1] + k
        unlike = (t[a] != t[b]) | (s_type[a] != s_type[b])
        differ[alive[unlike]] = True
        alive = alive[~unlike & (k < size[alive])]
        k += 1
    name = np.cumsum(differ) - 1
    known = np.zeros(len(order), np.int32)
    if name[-1] + 1 < len(order):
        named = np.full(n, -1, np.int32)
        named[order] = name
        ranks, shared = suffix_array(named[lms], int(name[-1]) + 1, store, short)
        order = lms[ranks]
        # Shared names are whole LMS substrings: so many symbols.
        known = lms[ranks + shared] - order
    common = np.zeros(len(order), np.int32)
    common[1:] = _agree(t, s_type, run, order[:-1], order[1:], known[1:])
    return _sorted_by_induction(t, s_type, run, back, order, common, sigma, store)


def repeated(bodies: list[bytes], weights: np.ndarray, width: int = WIDTH, memory: int = MEMORY, words: bool = False) -> list[np.ndarray]:
    """For each context the windows (True) whose string starts at two places at least; a context stands for as many
    copies as its weight. Symbols are bytes, or words' codes of eight bytes by rank."""
    lengths = np.array([len(b) for b in bodies]) // (8 if words else 1)
    starts = np.cumsum(lengths + 1) - lengths - 1
    store = Store(memory)
    t = store.array(int(lengths.sum()) + len(bodies) + 1, np.int32 if words else np.uint16, 1)  # 1 ends a context, 0 the text
    if words:
        known, rank = np.unique(np.frombuffer((b"\0" * 8).join(bodies), "<u8"), return_inverse=True)
        t[: len(rank)], sigma = rank.ravel(), len(known) + 2
        t[: len(rank)] += 2
    else:
        raw, sigma = np.frombuffer(b"\0".join(bodies), np.uint8), 258
        t[: len(raw)] = raw
        t[: len(raw)] += 2
    t[starts + lengths], t[-1] = 1, 0
    sa, common = suffix_array(t, sigma, store)
    # Only whole windows count. Neighbours among them agree as far as the smallest common prefix on the way.
    windows = np.maximum(lengths - width + 1, 0)
    inside = np.zeros(len(t), bool)
    inside[np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)] = True
    rank = np.flatnonzero(inside[sa])
    sa = np.array(sa[rank])
    same = np.zeros(len(sa), bool)
    if len(rank) > 1:
        same[1:] = np.minimum.reduceat(common, rank[:-1] + 1)[:] >= width
        last = rank[-2] + 1  # reduceat runs its last stretch to the end of the array
        same[-1] = common[last : rank[-1] + 1].min() >= width
    head = np.flatnonzero(~same)
    owner = np.searchsorted(starts, sa, side="right") - 1
    total = np.add.reduceat(weights[owner], head) if len(head) else np.zeros(0)
    twice = np.repeat(total > 1, np.diff(np.append(head, len(sa))))
    flags = np.zeros(len(t), bool)
    flags[sa[twice]] = True
    return [flags[a : a + n] for a, n in zip(starts, windows, strict=True)]


def decide(rows: list[tuple], kind: repeats.Kind = KIND, memory: int = MEMORY) -> list[tuple]:
    """(anchor, context, n, packed flags) of the contexts of whole shards that have a repeated window."""
    # The same context may stand in several shards of its anchor; it is one text here, and each shard takes its windows.
    unique = list({(r[0], r[3], len(r[6])): r for r in rows}.values())
    found = dict(zip([(r[0], r[3], len(r[6])) for r in unique], repeated([r[6] for r in unique], np.array([r[4] for r in unique]), kind.width, memory, kind.words), strict=True))
    out = []
    for r in rows:
        flags = found[r[0], r[3], len(r[6])]
        if r[2] > 1:
            flags = flags & (repeats.window_hashes(kind.codes(r[6]), kind.width) % np.uint64(r[2]) == r[1])
        if flags.any():
            out.append((r[0], r[3], len(flags), np.packbits(flags, bitorder="little").tobytes()))
    return out


def removals(scratch: Scratch, known: DataFrame, key: list[str], kind: repeats.Kind = KIND, memory: int = MEMORY) -> DataFrame:
    """key and its repeated windows: (lo, n, bits), with all of a block's windows where bits is null."""
    spots, contexts = repeats.find(scratch, known, key, kind)

    def solve(batches):
        for rows in repeats.chunks(batches, CHUNK):
            found = decide(rows, kind, memory)
            cols = list(zip(*found, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "context", "n", "bits"])

    dealt = repeats.shards(known, key, contexts, kind).repartition(partitions(known.sparkSession), "anchor", "shard").sortWithinPartitions("anchor", "shard", "context")
    found = dealt.mapInArrow(lean(solve), "anchor long, context long, n int, bits binary")
    keys = ["anchor", "context", "n"]
    some = scratch.settle(found.groupBy(*keys).agg(F.collect_list("bits").alias("bits")))  # a shard's part each
    whole = contexts.where("copies > 1").select(*keys, F.lit(None).cast("array<binary>").alias("bits"))
    part = some.join(contexts.where("copies = 1").select(*keys), keys)
    results = scratch.settle(whole.unionByName(part))
    marked = spots.join(results, keys).select(*key, "lo", "n", "bits")
    marks = scratch.settle(marked.groupBy(*key).agg(F.collect_list(F.struct("lo", "n", "bits")).alias("marks")))
    scratch.drop(spots, contexts, some, results)
    return marks


def _kept(raw: bytes, marks, width: int, words: bool = False) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes and maximal runs went. Windows of words take the white space after them
    along."""
    units, first = len(raw), None
    if words:
        data = np.frombuffer(raw, np.uint8)
        first, _, _ = repeats.words_in(data, np.array([0, len(data)]))
        units = len(first)
    edge = np.zeros(units + 1, np.int32)
    for m in marks:
        if m["bits"] is None:  # every window of the block
            if m["lo"] + m["n"] - 1 + width <= units:
                edge[m["lo"]] += 1
                edge[m["lo"] + m["n"] - 1 + width] -= 1
            continue
        for bits in m["bits"]:
            on = m["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little", count=m["n"]))
            np.add.at(edge, on, 1)
            np.add.at(edge, on + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(gone) else 0
    if words:  # from byte to word: what stands before the first word stays
        gone = np.repeat(np.concatenate(([False], gone)), np.diff(np.concatenate(([0], first, [len(raw)]))))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), runs


def rewrite(docs: DataFrame, key: list[str], marks: DataFrame, width: int = WIDTH, decode: bool = False, words: bool = False) -> DataFrame:
    """docs' columns with n_bytes, n_removed, n_spans and kept of every row: the remaining bytes, or their whole characters
    as a text."""
    names = docs.columns
    own = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NO_ID)).alias("doc_id"),
        F.xxhash64("text").alias("th"), "text",
    )
    both = own.join(marks, key, "left").select(*[f"c{k}" for k in range(len(names))], "text", "marks")
    fields = [*docs.schema.fields]
    schema = both.select(*[f"c{k}" for k in range(len(names))]).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if decode else "binary")):
        schema = schema.add(name, kind)

    def each(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, gone, runs = _kept(raw, found, width, words) if found else (raw, 0, 0)
                out.append((len(raw), gone, runs, left.decode(errors="ignore") if decode else left))
            cols = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string() if decode else pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *arrays], names=[*(f"c{k}" for k in range(len(names))), "n_bytes", "n_removed", "n_spans", "kept"])

    out = both.mapInArrow(lean(each), schema)
    results = [c for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    own = [F.col(f"c{k}").alias(f.name) for k, f in enumerate(fields) if f.name not in results]  # a clashing column gives way
    return out.select(*own, *results)


def dedup(docs: DataFrame, kind: repeats.Kind = KIND, memory: int = MEMORY, decode: bool = False) -> DataFrame:
    scratch = Scratch(tune(docs.sparkSession))
    known, key = repeats.keyed(docs, with_null=True)
    return rewrite(docs, key, removals(scratch, known, key, kind, memory), kind.width, decode, kind.words)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs' columns with the text that is left without passages of over 50 words that stand at several places. Words are
    cut whole; n_chars, where there is one, is counted again for the texts that changed. Null texts stay null."""
    wide = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    out = dedup(wide, WORDS, decode=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    cols = {"text": text}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[cols.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
