"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Kernel: gap-weighted subsequences of three characters inside one word, its edges included as characters, over spans of
at most five (longer spans have vanishing weight under the decay), so that inserted and dropped characters cost
little. It is divided by the norms of its arguments; a word's norm is that of a word of its length whose subsequences
all differ. Before words are formed, punctuation inside them is dropped and runs of three or more single characters are
joined, so spaced-out and dotted spellings are one word with its gaps.

Training: labels belong to documents, and an insult is inside one word, whatever is inserted between its letters; so the
labelled instances are words, not whole sentences: each word of a document carries the document's label. Landmarks are the words of the bounded training sample that separate the labels best, one half
for each side. Words are mapped by K(x, Z) K(Z, Z)^(-1/2); a linear SVM is fitted on clean sentences' words and the
witnesses of toxic documents, which are chosen anew in each round (multiple-instance learning). Because the decision
function is a sum over subsequences, the landmarks fold into one hashed weight table, and scoring costs a few
look-ups a character. A document's margin is the largest of its words', the next two count as well; a logistic
curve fitted on the sample turns it into the score.

Defined results: null and empty texts, texts without a letter, and all texts when the training rows hold only one label
or none get the sample's lowest score (0 when there is no model); rows that share doc_id give a row each; labels that
contradict each other count as toxic; documents without a label are scored but never learnt from; other columns are
ignored. Texts are scored whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, lean, tune

SAMPLE, LANDMARKS, ROUNDS, DECAY, BUCKETS, THRESHOLD = 2000, 768, 3, 0.6, 1 << 18, 0.7
#: Characters in work at a time.
SLICE = 1 << 19
#: One clear insult should tell by itself: the logistic curve's weights of the three margins are drawn to these.
PRIOR, PULL = (4.0, 2.0, 1.0), 5.0
#: Positions of a subsequence's second and third character after its first, for spans of three to five.
GAPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 for letters and digits, 2 for white space, 0 for what is dropped."""
    t = np.fromiter((1 if (c := chr(k)).isalnum() else 2 if c.isspace() else 0 for k in range(0x110000)), np.uint8, 0x110000)
    return t


def stream(texts: list[str], join: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with 0 between words; each word's first position, length and text number."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([1, *[len(t) + 1 for t in low]])
    kind = _kinds()[codes]
    kept = np.flatnonzero(kind)
    x = np.where(kind[kept] == 1, codes[kept], 0).astype(np.uint64)
    doc = np.searchsorted(bounds, kept, side="right") - 1
    inside = x != 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
    first, end = edge[::2] + 1, edge[1::2] + 1
    single = end - first == 1
    joined = single[1:] & single[:-1] & (first[1:] - end[:-1] == 1) & (doc[first[1:]] == doc[first[:-1]])
    if join and joined.any():  # only runs of three or more single characters
        run = np.concatenate(([False], joined, [False]))
        long = (run[1:-1] & (run[:-2] | run[2:])) if len(run) > 2 else run[1:-1]
        keep = np.ones(len(x), bool)
        keep[end[:-1][long]] = False
        x, doc = x[keep], doc[keep]
        inside = x != 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
        first, end = edge[::2] + 1, edge[1::2] + 1
    return x, first, end - first, doc[first] if len(first) else np.zeros(0, np.int64)


def subsequences(x: np.ndarray):
    """For every gap pattern: positions after the first character of its subsequences, their buckets and weight."""
    inside = x != 0
    for b, c in GAPS:
        n = len(x) - c
        if n <= 0:
            continue
        ok = inside[1 : n + 1].copy()
        for k in range(2, c):
            ok &= inside[k : n + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), 7, np.uint64)
        for k in (0, b, c):
            h = (h ^ x[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        yield at + 1, (h & np.uint64(BUCKETS - 1)).astype(np.int64), DECAY ** (c - 2)


def norms(length: np.ndarray) -> np.ndarray:
    """Norm of a word of each length, edges included, if no subsequence occurs twice."""
    total = sum(DECAY ** (2 * (c - 2)) * np.maximum(length + 2 - c, 0) for _, c in GAPS)
    return np.sqrt(np.maximum(total, 1e-12))


def margins(x: np.ndarray, first: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The folded decision function of every word, without the bias."""
    if not len(first):
        return np.zeros(0)
    acc = np.zeros(len(x))
    for at, bucket, w in subsequences(x):
        acc[at] += w * table[bucket]
    return np.add.reduceat(acc, first) / norms(length)


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and normalised weights of the subsequences of each word."""
    x, first, length, _ = stream(words, join=False)
    word = np.cumsum((x != 0) & (np.concatenate(([0], x[:-1])) == 0)) - 1
    parts = [(word[at], bucket, np.full(len(at), w)) for at, bucket, w in subsequences(x)]
    of, bucket, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
    weight = weight / norms(length)[of]
    order = np.argsort(of, kind="stable")
    of, bucket, weight = of[order], bucket[order], weight[order]
    cut = np.searchsorted(of, np.arange(len(words) + 1))
    return [(bucket[a:b], weight[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def kernel(rows: list, landmarks: list) -> np.ndarray:
    """The string kernel between words and landmarks, through the landmarks' dense tables in blocks."""
    out = np.zeros((len(rows), len(landmarks)))
    flat = np.concatenate([b for b, _ in rows]) if rows else np.zeros(0, np.int64)
    weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
    cut = np.cumsum([0, *[len(b) for b, _ in rows]])[:-1]
    used, where = np.unique(flat, return_inverse=True)
    for k, (b, w) in enumerate(landmarks):
        dense = np.zeros(len(used))
        at = np.searchsorted(used, b)
        hit = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == b)
        np.add.at(dense, at[hit], w[hit])
        out[:, k] = np.add.reduceat(weight * dense[where], cut)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss and a bias (last weight), by Newton steps in the primal (Chapelle, 2007)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * cost[on][:, None]
        goal = np.linalg.solve(a.T @ x[on] + ridge, a.T @ y[on])
        step, new = 1.0, loss(goal)
        while new > now and step > 1e-4:
            step /= 2
            new = loss(w + step * (goal - w))
        w = w + step * (goal - w)
        if now - new < 1e-6 * max(1.0, now):
            break
        now = new
    return w


def tops(m: np.ndarray, doc: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The margins of each document's three most telling words, clipped at that of a sure word; bias where there are fewer."""
    m = np.clip(m, bias, 1.2)
    order = np.lexsort((-m, doc))
    m, doc = m[order], doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    best = np.full((n, 3), bias)
    top = rank < 3
    best[doc[top], rank[top]] = m[top]
    return best


def slices(texts: list[str | None], limit: int = SLICE):
    """(numbers, parts) of texts of about ``limit`` characters together; a longer text is cut at white space."""
    numbers, parts, size = [], [], 0
    for k, t in enumerate(texts):
        t, at = t or "", 0
        while at < len(t) or not at:
            stop = min(len(t), at + limit)
            if stop < len(t):
                space = max(t.rfind(" ", at, stop), t.rfind("\n", at, stop))
                stop = space if space > at else stop
            if parts and size + stop - at > limit:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(k)
            parts.append(t[at:stop])
            size += stop - at
            at = max(stop, 1)
    if parts:
        yield numbers, parts


class Model:
    """A hashed weight table (BUCKETS floats), its bias, and the logistic curve's weights."""

    def __init__(self, table: np.ndarray, bias: float, curve):
        self.table, self.bias, self.curve = table.astype(np.float32), float(bias), np.asarray(curve, float)

    def document_margins(self, texts: list[str | None]) -> np.ndarray:
        """How sure each text's three most telling words are: their margins through a steep logistic step."""
        best = np.full((len(texts), 3), self.bias)
        for numbers, parts in slices(texts):
            x, first, length, doc = stream(parts)
            found = tops(margins(x, first, length, self.table) + self.bias, doc, len(parts), self.bias)
            for k, own in zip(numbers, found, strict=True):
                best[k] = np.sort(np.concatenate([best[k], own]))[:2:-1]
        return 1 / (1 + np.exp(-8 * (np.maximum(best, -1.0) - 0.6)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.document_margins(texts) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _platt(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve of the label by a document's margins (Platt, 1999), by Newton steps with smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([m, np.ones((len(m), 1))])
    ridge = np.diag([PULL] * m.shape[1] + [1e-6])
    a = prior = np.array([*PRIOR, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ (a - prior))
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        a = a - step
        if np.abs(step).max() < 1e-8:
            break
    return a


def _bands(ids: np.ndarray, bands: int = 5, rows: int = 3) -> set:
    """Min-hash bands of a document's pairs of neighbouring words: near copies share one."""
    pairs = ids.astype(np.uint64) if len(ids) < 2 else ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + ids[1:].astype(np.uint64)
    if not len(pairs):
        return {()}
    out = set()
    for b in range(bands):
        key = [b]
        for r in range(rows):
            h = (pairs + np.uint64(1 + b * rows + r)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            key.append(int((h ^ (h >> np.uint64(29))).min()))
        out.add(tuple(key))
    return out


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    """The model of a bounded sample of documents held in memory."""
    y = toxic.astype(int)
    if y.min(initial=1) == y.max(initial=0):
        return None
    # Documents as sets of distinct words: a word is a string without spaces here.
    vocabulary: dict[str, int] = {}
    sets: list[np.ndarray] = []
    bands: set = set()
    alone = np.ones(len(texts), bool)
    for k, t in enumerate(texts):
        x, first, length, _ = stream([t])
        chars = x.astype(np.uint32)
        words = [chars[a : a + n].tobytes().decode("utf-32-le", "surrogatepass") for a, n in zip(first, length, strict=True)]
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        # A copied document is one witness, however often it was copied: only the first of near copies counts.
        mine = _bands(ids)
        alone[k] = not (mine & bands)
        bands |= mine
        sets.append(np.unique(ids))
    texts, y, sets = [t for t, a in zip(texts, alone, strict=True) if a], y[alone], [s for s, a in zip(sets, alone, strict=True) if a]
    if y.min(initial=1) == y.max(initial=0):
        return None
    names = np.array(list(vocabulary), object)
    df = np.zeros((2, len(names)))
    for s, k in zip(sets, y, strict=True):
        df[k][s] += 1
    share = df / np.array([[max(1, (y == 0).sum())], [max(1, (y == 1).sum())]])
    pooled = (df.sum(axis=0) + 1) / (len(y) + 2)
    z = (share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / max(1, (y == 1).sum()) + 1 / max(1, (y == 0).sum())))
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))  # ties by the word itself
    order = np.lexsort((place, -z))
    half = landmarks // 2
    # The other half: words of clean documents most like the first (hard negatives come in with the rounds), and common ones.
    common = np.lexsort((place, -df[0]))
    picked = list(dict.fromkeys([*order[:half].tolist(), *common[:half].tolist()]))[:landmarks]
    marks = features(names[picked].tolist())
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K(Z, Z)^(-1/2) up to rotation
    # Only words whose tie to the label is beyond chance can be witnesses; most words of any text occur once.
    eligible = (share[0] <= 0.1 * share[1]) & (z >= min(3.0, z.max()))
    current = np.where(eligible, z, -np.inf)
    clean_words = np.flatnonzero(df[0] > 0)
    spread = clean_words[:: max(1, len(clean_words) // 4000)]
    hard = np.array([], np.int64)
    balance = (y == 1).sum() / (y == 0).sum() * 2
    table, bias, sure = np.zeros(BUCKETS), 0.0, 4.0
    for _ in range(rounds):
        # A toxic document's witnesses: its most telling word, and what else speaks clearly for the label.
        witness = np.zeros(len(names))
        for s, k in zip(sets, y, strict=True):
            own = s[eligible[s]] if k else s[:0]
            if len(own):
                witness[own[(current[own] >= sure) | (current[own] == current[own].max())]] += 1
        pos = np.flatnonzero(witness)
        neg = np.union1d(hard, np.union1d(spread, pos[df[0][pos] > 0]))  # a word seen on both sides counts on both
        if not len(pos) or not len(neg):
            return None
        both = np.concatenate([pos, neg])
        phi = kernel(features(names[both].tolist()), marks) @ root
        target = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.concatenate([np.minimum(50.0, 2 * witness[pos]), np.clip(df[0][neg] * balance, 0.5, 10.0)])
        cost[: len(pos)] *= min(1.0, cost[len(pos) :].sum() / cost[: len(pos)].sum())  # neither side outweighs the other
        w = svm(phi, target, cost)
        beta, bias = root @ w[:-1], float(w[-1])
        table = np.zeros(BUCKETS)
        for b, (bucket, weight) in zip(beta, marks, strict=True):
            np.add.at(table, bucket, b * weight)
        for at in range(0, len(names), 50_000):
            x, first, length, _ = stream(names[at : at + 50_000].tolist(), join=False)
            current[at : at + 50_000] = margins(x, first, length, table)
        sure = -bias  # a positive decision
        hard = np.union1d(hard, clean_words[np.argsort(-current[clean_words], kind="stable")[:2000]])
    model = Model(table, bias, np.zeros(4))
    model.curve = _platt(model.document_margins(texts), y)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from docs' text and labels' toxic on about ``sample`` doc_ids of each label, chosen by hash, and of each the row
    whose text has the smallest hash, so that a doc_id of many rows is no more than one."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    found = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows
    if not found:
        return None
    rate = F.lit(0.0)
    for k, n in found.items():
        rate = F.when(F.col("_toxic") == k, F.lit(min(1.0, sample / n))).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.broadcast(known.where(unit < rate))  # about twice ``sample`` ids
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("b")
    rows = rows.groupBy("doc_id", "_toxic").agg(one).select(F.col("b.text").alias("text"), "_toxic")

    def learn(batches):
        texts: list[str] = []
        toxic: list[int] = []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda k: (texts[k], toxic[k]))
        model = fit([texts[k] for k in order], np.array([toxic[k] for k in order], np.int64)) if texts else None
        if model is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.table.tobytes()]), pa.array([model.bias]), pa.array([model.curve.tolist()])], names=["t", "b", "c"]
            )

    # The sample is bounded, so one task may hold it; the shuffle before it keeps scan and join in tasks of their own.
    got = rows.repartition(1).mapInArrow(lean(learn), "t binary, b double, c array<double>").collect()
    return Model(np.frombuffer(got[0]["t"], np.float32), got[0]["b"], got[0]["c"]) if got else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of BUCKETS floats

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(each), "doc_id long, score double")


def reject(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.score(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(lean(each), docs.schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    return train(docs, documents(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tune(spark), sf_dir)
    out = score(docs, trained(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
