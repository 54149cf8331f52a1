"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Training: character 3-, 4- and 5-grams of the words of a bounded sample of labelled documents (about ``per_lang`` per
language, chosen by hash) are counted by language in Spark and turned into hashed log-probability tables. A language's
scripts are those of at least one in fifty of its training words.

Labelling: a text is cut into words (runs of letters). The script of a word narrows the languages that may label it;
each gets the word's n-gram score; Viterbi with a penalty for each switch labels the whole sequence, and runs of one
label are the spans. The prediction is the language whose spans hold most letters, the score its share of the letters.

Defined results: a null text, one without a letter, and any text when there is nothing to learn from are ``und`` with
score 0; a word whose script no learned language uses scores alike for all; ties go to the language first by code
point; rows that share doc_id give a row each; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, lean, tune

PER_LANG, BUCKETS, ORDERS, PENALTY, SHARPNESS, FLOOR = 3000, 1 << 17, (3, 4, 5), 6.0, 0.5, -30.0

# First and last code point of the ranges that tell scripts apart (Unicode block table).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script number of every code point that is a letter (OTHER outside the ranges), 0 for all that is none."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    t = np.full(0x110000, OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            t[lo : hi + 1] = k
    t[~letter] = 0
    return t


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank before each and one at the end; and where each text begins."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1, *[len(t) + 1 for t in low]])
    return codes, starts


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position and end of every word, and the script of each position (0: no letter)."""
    script = script_table()[codes]
    edge = np.flatnonzero(np.diff((script != 0).astype(np.int8)))  # the array begins and ends with a blank
    return edge[::2] + 1, edge[1::2] + 1, script


def grams(codes: np.ndarray, letter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose n-gram lies in one word (an end may be the word's edge), given by the position after its first
    character, and the n-gram's bucket. What is no letter counts as an edge."""
    x = np.where(letter, codes, 0).astype(np.uint64)
    size = len(x) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = letter[1 : size + 1].copy()
    for k in range(2, n - 1):
        inside &= letter[k : size + k]
    at = np.flatnonzero(inside)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ x[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at + 1, (h & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """Languages, their scripts and one table of log-probabilities per n-gram order. Bounded by languages x BUCKETS."""

    def __init__(self, langs: list[str], counts: dict[int, np.ndarray], scripts: np.ndarray):
        self.langs, self.scripts = langs, scripts
        self.tables = {}
        for n, c in counts.items():  # c: languages x BUCKETS
            p = np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
            self.tables[n] = np.ascontiguousarray(((p - p.mean(axis=0)) * SHARPNESS).T.astype(np.float32))

    def word_scores(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray, script: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), len(self.langs)))
        if not len(first):
            return out
        letter = script != 0
        word = np.cumsum(letter & ~np.concatenate(([False], letter[:-1]))) - 1
        for n, table in self.tables.items():
            at, bucket = grams(codes, letter, n)
            of = word[at]
            if not len(of):
                continue
            begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sums = np.add.reduceat(table[bucket], begins, axis=0)
            out[of[begins]] += sums
        fits = self.scripts[:, script[first]].T  # words x languages
        return np.where(fits | ~fits.any(axis=1, keepdims=True), out, FLOOR + out.min(axis=1, keepdims=True))


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Label of every word: documents hold count[d] words from first[d] on; all documents step together."""
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    order = np.argsort(-count, kind="stable")
    begin, steps = first[order], count[order]
    active = np.searchsorted(-steps, -np.arange(steps[0]), side="left")  # documents with more than t words
    back = np.zeros(scores.shape, np.int16)
    v = np.zeros((len(order), scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(steps[0]):
        a = active[t]
        at = begin[:a] + t
        now = v[:a]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(a), best][:, None] - penalty
            switch = now < jump
            back[at] = np.where(switch, best[:, None], own)
            now = np.where(switch, jump, now)
        v[:a] = now + scores[at]
    state = v.argmax(axis=1).astype(np.int16)
    for t in range(steps[0] - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        label[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return label


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of one label in a text, in characters of its lower-cased form."""
    codes, _ = encode([text])
    first, end, script = words_of(codes)
    label = viterbi(model.word_scores(codes, first, end, script), np.array([0]), np.array([len(first)]))
    cut = [0, *(np.flatnonzero(np.diff(label)) + 1), len(label)] if len(label) else [0]
    return [(int(first[a]) - 1, int(end[b - 1]) - 1, model.langs[label[a]]) for a, b in zip(cut, cut[1:], strict=False)]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    codes, starts = encode([t or "" for t in texts])
    first, end, script = words_of(codes)
    scores = model.word_scores(codes, first, end, script)
    at = np.searchsorted(first, starts)
    label = viterbi(scores, at[:-1], np.diff(at))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    n = len(model.langs)
    share = np.bincount(doc * n + label, weights=end - first, minlength=len(texts) * n).reshape(-1, n)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    lang = [model.langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
    return lang, np.where(total > 0, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learns from docs' text and lang. About per_lang documents of a language, by hash, are read."""
    spark = docs.sparkSession
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not found:
        return None
    langs = sorted(found)
    rate = spark.createDataFrame([(x, min(1.0, per_lang / found[x])) for x in langs], "lang string, _rate double")
    unit = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(F.broadcast(rate), "lang").where(unit < F.col("_rate")).select("lang", "text")

    def tally(batches):
        total: dict[tuple[str, int, int], float] = {}
        for b in batches:
            lang, text = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for x in set(lang.tolist()):
                codes, _ = encode([t for t, y in zip(text, lang, strict=True) if y == x])
                first, _, script = words_of(codes)
                keys = [(0, np.bincount(script[first], minlength=OTHER + 1))]
                keys += [(n, np.bincount(grams(codes, script != 0, n)[1], minlength=BUCKETS)) for n in ORDERS]
                for n, c in keys:
                    total[x, n] = total.get((x, n), 0) + c
        for (x, n), c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(k)), pa.array(np.full(len(k), n), pa.int32()), pa.array(k, pa.int32()), pa.array(c[k].astype(np.int64))],
                names=["lang", "n", "bucket", "c"],
            )

    counted = sample.mapInArrow(lean(tally), "lang string, n int, bucket int, c long").groupBy("lang", "n", "bucket").agg(F.sum("c").alias("c"))
    table = counted.toArrow().to_pandas() if hasattr(counted, "toArrow") else counted.toPandas()  # languages x orders x BUCKETS at most
    row = table["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()
    counts = {n: np.zeros((len(langs), BUCKETS if n else OTHER + 1)) for n in (0, *ORDERS)}
    for n, c in counts.items():
        m = (table["n"] == n).to_numpy()
        c[row[m], table["bucket"].to_numpy()[m]] = table["c"].to_numpy()[m]
    used = counts.pop(0)
    return Model(langs, counts, used * 50 >= np.maximum(used.sum(axis=1, keepdims=True), 1))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x BUCKETS

    def each(batches):
        for b in batches:
            lang, score = predict(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(each), "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tune(spark), sf_dir)
    out = identify(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
