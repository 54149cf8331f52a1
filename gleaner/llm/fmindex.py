"""Substring dedup by a compressed FM-index per shard.

Units are words. A window of WIDTH words is removed where its word sequence also starts in a document with a smaller
doc_id. Candidate contexts come from ``repeats``; equal contexts are one, with the smallest doc_id that has it. A shard's
contexts form one text: its Burrows-Wheeler transform is kept in a wavelet tree of packed bit vectors with sampled
ranks. Contexts are streamed through it by backward search, all positions in step; the matching statistics are followed
up to WIDTH, and positions that reach it report the smallest document of their suffix-array interval.

Defined results: a null text has no words; a null doc_id neither removes nor loses words; rows that share doc_id don't
remove each other's words; a repeat inside one document stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import repeats
from gleaner.llm.common import documents, lean, partitions, tune, Scratch

WIDTH, GRAM, CHUNK = 13, 4, 4 << 20
_CODE = 6  # bytes kept of a word's 64-bit code in a shard


def _units(data: np.ndarray, offsets: np.ndarray):
    first, end, bounds = repeats.words_in(data, offsets)
    return repeats.word_codes(data, first, end), bounds


def _coded(codes: np.ndarray) -> np.ndarray:
    return codes


def _cut(raw: bytes, at: list[int], n: list[int]) -> list[bytes | None]:
    data = np.frombuffer(raw, np.uint8)
    codes, _ = _units(data, np.array([0, len(data)]))
    short = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CODE])
    return [short[a : a + k - 1 + WIDTH].tobytes() if a + k - 1 + WIDTH <= len(codes) else None for a, k in zip(at, n, strict=True)]


def _codes(body: bytes) -> np.ndarray:
    short = np.frombuffer(body, np.uint8).reshape(-1, _CODE)
    return np.hstack([short, np.zeros((len(short), 8 - _CODE), np.uint8)]).view("<u8").ravel()


KIND = repeats.Kind(WIDTH, GRAM, True, _units, _coded, _cut, _codes)


class BitVector:
    """Packed bits with a rank sample every 64."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Levels of bit vectors over a sequence of small numbers, most significant bit first (a wavelet matrix)."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each symbol c before position i."""
        lo, hi = np.zeros_like(i), i.copy()
        for level, (v, z) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = v.ones(lo), v.ones(hi)
            lo = np.where(one, z + a, lo - a)
            hi = np.where(one, z + b, hi - b)
        return hi - lo


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s by their first ``depth`` symbols at least (prefix doubling)."""
    rank = s.astype(np.int64)
    span = 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        nxt = np.full(len(s), -1, np.int64)
        nxt[:-span] = rank[span:]
        key = rank * (int(rank.max()) + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))
        span *= 2
        if rank.max() == len(s) - 1:
            break
    return order


class FMIndex:
    """Contexts one after the other, each ended by the symbol 0."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        self.alphabet, s = np.unique(flat, return_inverse=True)
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(len(flat) + len(lengths), np.int64)
        at = np.repeat(starts, lengths) + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[at] = s + 1
        self.text, self.starts, self.lengths = text, starts, lengths
        # Suffixes that agree over a whole window need no further order: the window's interval is the same.
        sa = suffix_array(text, WIDTH)
        sigma = len(self.alphabet) + 1
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        owner = np.repeat(owners, lengths + 1)[sa]
        self.low = [owner]  # sparse table of minima
        while len(self.low[-1]) > 1 << (len(self.low) - 1):
            half = 1 << (len(self.low) - 1)
            if len(self.low[-1]) <= half:
                break
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def statistics(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follows the matching statistics of the streamed contexts, all ends of whole windows in step, by backward search.
        An end is given up when only one place is left, which is its own. Returns the ends whose match reaches the
        width, and their suffix-array intervals."""
        windows = np.maximum(self.lengths - width + 1, 0)
        begin = np.repeat(self.starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        end, lo, hi = begin + width, np.zeros(len(begin), np.int64), np.full(len(begin), len(self.text), np.int64)
        for step in range(width):
            c = self.text[end - 1 - step]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            shared = hi - lo > 1
            end, lo, hi = end[shared], lo[shared], hi[shared]
        return end, lo, hi

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in each interval."""
        k = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
        k = np.minimum(k, len(self.low) - 1)
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            m = k == level
            t = self.low[level]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << int(level))])
        return out


def decide(rows: list[tuple], kind: repeats.Kind = KIND) -> list[tuple]:
    """For each context of whole shards the windows, as offsets, that a smaller document has, with that document:
    (anchor, context, n, offsets, lows)."""
    flat = kind.codes(b"".join(r[6] for r in rows))
    lengths = np.array([len(r[6]) // _CODE for r in rows])
    owners = np.array([r[5] for r in rows], np.int64)
    index = FMIndex(flat, lengths, owners)
    end, lo, hi = index.statistics(WIDTH)
    out = []
    low = index.smallest(lo, hi)
    which = np.searchsorted(index.starts, end - 1, side="right") - 1
    better = low < owners[which]
    end, low, which = end[better], low[better], which[better]
    offset = end - WIDTH - index.starts[which]
    cut = np.searchsorted(which, np.arange(len(rows) + 1))
    for k in np.unique(which):
        r, mine = rows[k], slice(cut[k], cut[k + 1])
        o, lows = offset[mine], low[mine]
        if r[2] > 1:  # this shard decides on its own windows only
            own = repeats.window_hashes(kind.codes(r[6]), WIDTH)[o] % np.uint64(r[2]) == r[1]
            o, lows = o[own], lows[own]
        out.append((r[0], r[3], int(lengths[k]) - WIDTH + 1, o.tolist(), lows.tolist()))
    return out


def removals(scratch: Scratch, known: DataFrame, key: list[str], kind: repeats.Kind = KIND) -> DataFrame:
    """key and its removed windows as (lo, mask) pairs: bit j of mask is the window that starts at lo + j."""
    spots, contexts = repeats.find(scratch, known, key, kind)

    def solve(batches):
        for rows in repeats.chunks(batches, CHUNK):
            found = decide(rows, kind)
            cols = list(zip(*found, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "context", "n", "offsets", "lows"])

    dealt = repeats.shards(known, key, contexts, kind).repartition(partitions(known.sparkSession), "anchor", "shard").sortWithinPartitions("anchor", "shard", "context", "low")
    found = dealt.mapInArrow(lean(solve), "anchor long, context long, n int, offsets array<int>, lows array<long>")
    lower = found.groupBy("anchor", "context", "n").agg(F.flatten(F.collect_list(F.arrays_zip("offsets", "lows"))).alias("lower"))
    lower = scratch.settle(lower)
    keys = ["anchor", "context", "n"]
    # A context's windows are in its smallest document, or in a smaller one that the index reports.
    results = scratch.settle(contexts.select(*keys, F.col("first.doc_id").alias("low"), "copies").join(lower, keys, "left").where("copies > 1 OR lower IS NOT NULL"))
    hit = F.expr("""
        aggregate(coalesce(lower, array()), if(doc_id > low, shiftleft(1L, n) - 1L, 0L),
                  (m, w) -> if(w.lows < doc_id, m | shiftleft(1L, w.offsets), m))""")
    marked = spots.join(results, keys).select(*key, "lo", hit.alias("mask")).where("mask <> 0")
    marks = scratch.settle(marked.groupBy(*key).agg(F.collect_list(F.struct("lo", "mask")).alias("marks")))
    scratch.drop(spots, contexts, lower, results)
    return marks


def rewrite(docs: DataFrame, key: list[str], marks: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every row of docs."""

    def each(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or "").encode().split()  # splits at the same six bytes
                kept = words
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for m in found:
                        for j in range(m["mask"].bit_length()):
                            if m["mask"] >> j & 1 and m["lo"] + j + WIDTH <= len(words):
                                gone[m["lo"] + j] += 1
                                gone[m["lo"] + j + WIDTH] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.xxhash64("text").alias("th")] if len(key) > 1 else []))
    both = own.join(marks, key, "left").select("doc_id", "text", "marks")
    return both.mapInArrow(lean(each), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup(docs: DataFrame, texts: bool = False, kind: repeats.Kind = KIND) -> DataFrame:
    scratch = Scratch(tune(docs.sparkSession))
    known, key = repeats.keyed(docs, with_null=False)
    return rewrite(docs, key, removals(scratch, known, key, kind), texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x),
m AS (SELECT s, min(doc_id) AS low FROM h GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (s) WHERE low < doc_id
), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
