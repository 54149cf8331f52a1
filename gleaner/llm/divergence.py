"""Source divergence audit: how far each source's use of words lies from every other source's and from its language's.

Sort-based streaming. Each task counts the terms of its documents and emits records of a term, source and stretch of documents;
the records are repartitioned by (lang, term) and sorted by a hash of (lang, term), then (lang, term, source, document), and a scan
over runs adds up document frequencies and counts and keeps the terms of at least MIN_DOCS documents. A second scan, with the totals known, emits partial
sums for the pairs of sources that share a term and a row for each term.

The sum over all kept terms for a pair (P, Q) is taken apart, exactly: terms that only one of both has depend on a count of P or
of Q alone, so they are summed over the counts' histograms as if no term were shared, terms that neither has are one value times
their number, and the scan of runs adds for each shared term what the histograms got wrong.

A term that a third of all documents hold stays in the counts of its task until the task ends, so it is a record a task and
source and not one a document. Pairs are summed inside a task and leave it as sums; the result itself has a row a pair.

Defined results: null text, lang and source are ''; a row is a document, whatever its doc_id, so equal rows count each; a document of
any length is counted in slices; an empty table gives an empty result; ties go to the smaller item by UTF-8 bytes; other columns of the
table are never read. Numbers are exact: decimals where a product can pass a long.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, lean, partitions, tune

MIN_DOCS, TOP, SCALE, HELD, OFTEN, SLICE, WIDTH = 3, 200, 1_000_000_000, 600_000, 8, 1 << 20, 1024
#: Bytes outside of terms become blanks and A-Z lower case; UTF-8 writes all that isn't ASCII in bytes from 0x80 on.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slices(text: bytes, size: int = SLICE):
    """Lists of a text's terms, slice by slice; no term is cut."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= size else folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Records (key, source, document, df, n): a term's counts over a stretch of documents of one task, named by its first one; key
    is lang and term. Once a task holds ``held`` terms, those of few documents leave it; frequent ones stay and leave once at its end."""
    names = ["key", "source", "document", "df", "n"]

    def walk(batches):
        groups, first, keys = {}, None, 0

        def emit(least):
            nonlocal keys
            for (lang, source), (df, n) in groups.items():
                stay = [t for t, k in df.items() if k >= least] if least else []
                kept = Counter({t: df[t] for t in stay}), Counter({t: n[t] for t in stay})
                for t in stay:
                    df[t] = 0
                terms, prefix = [t for t, k in df.items() if k], lang.encode() + b"\0"
                for at in range(0, len(terms), 20_000):
                    some = terms[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([prefix + t for t in some], pa.binary()).cast(pa.string()), pa.repeat(pa.scalar(source, pa.string()), len(some)), pa.repeat(pa.scalar(first, pa.int64()), len(some)),
                         pa.array([df[t] for t in some], pa.int64()), pa.array([n[t] for t in some], pa.int64())], names=names)
                groups[lang, source], keys = kept, keys - len(terms)

        for b in batches:
            for doc, lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                df, n = groups.setdefault((lang, source), (Counter(), Counter()))
                first, seen, before = doc if first is None else first, set(), len(n)
                for terms in slices(text):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                keys += len(n) - before
                if keys > held:
                    yield from emit(OFTEN)
                    if 2 * keys > held:
                        yield from emit(0)
                    first = None
        yield from emit(0)

    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("document"), _escaped(F.coalesce(F.col("lang").cast("string"), empty)).alias("lang"),
        F.coalesce(F.col("source").cast("string"), empty).alias("source"), F.coalesce(F.col("text"), empty).cast("binary").alias("text"))
    return rows.mapInArrow(lean(walk), "key string, source string, document long, df long, n long")


def _escaped(lang: Column) -> Column:
    """A language without the mark that parts it from a term in a key."""
    return F.replace(F.replace(lang, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))


def _plain(lang: Column) -> Column:
    return F.replace(F.replace(lang, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The positions at which a run of equal keys begins."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        c = t[k].combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_runs(batches, keys: list[str]):
    """Tables that end where a run of equal keys does, from sorted batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        t = t if held is None else pa.concat_tables([held, t])
        last = int(_changes(t, keys)[-1])
        if last:
            yield t.slice(0, last)
        held = pa.table([c.combine_chunks() for c in t.slice(last).columns], names=t.column_names)
    if held is not None:
        yield held


def _sorted_runs(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *by).sortWithinPartitions(*order)


def cells(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """(lang, term, source, n, lang_n, head): a source's and the language's count of each kept term; head is 1 once a term."""

    def scan(batches):
        for t in _whole_runs(batches, ["key"]):
            term, own = _changes(t, ["key"]), _changes(t, ["key", "source"])
            df, n = t["df"].to_numpy(), t["n"].to_numpy()
            of = np.searchsorted(term, own, side="right") - 1  # the term of each run of one source
            kept = (np.add.reduceat(df, term) >= min_docs)[of]
            head = np.isin(own, term).astype(np.int64)
            out = t.select(["key", "source"]).take(pa.array(own[kept]))
            for name, column in (("n", np.add.reduceat(n, own)), ("lang_n", np.add.reduceat(n, term)[of]), ("head", head)):
                out = out.append_column(name, pa.array(column[kept]))
            yield from out.to_batches(20_000)

    # A hash of the key comes first: keys of a language begin alike, and the sort compares the first eight bytes before anything else.
    dealt = _sorted_runs(counted(docs, held), ["key"], [F.xxhash64("key"), "key", "source", "document"])
    found = dealt.select("key", "source", "df", "n").mapInArrow(lean(scan), "key string, source string, n long, lang_n long, head long")
    parts = F.split("key", "\0", 2)
    return found.select(_plain(F.get(parts, F.lit(0))).alias("lang"), F.get(parts, F.lit(1)).alias("term"), "source", "n", "lang_n", "head")


def _share(count: Column, total: Column) -> Column:
    """p = 1 + floor(SCALE * (count + 1) / total)."""
    d = lambda c, k: c.cast(f"decimal({k},0)")
    return (F.lit(1) + F.call_function("div", d(F.lit(SCALE), 10) * d(count + 1, 20), d(total, 20))).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared(placed: DataFrame) -> DataFrame:
    """(lang, source, item, value): partial sums of what terms that both sources hold change, from (lang, term, source, p, p0)."""

    def walk(batches):
        lang, code, total = None, {}, np.zeros((0, 0), np.int64)

        def emit(rows, columns, sums):
            a, b = np.nonzero(rows[:, None] != columns[None, :])
            for at in range(0, len(a), 20_000):
                i, j = a[at : at + 20_000], b[at : at + 20_000]
                took = lambda k: pa.array(names, pa.string()).take(pa.array(k))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), took(rows[i]), took(columns[j]), pa.array(sums[i, j])], names=["lang", "source", "item", "value"])

        for t in _whole_runs(batches, ["lang", "term"]):
            at = _changes(t, ["lang", "term"])
            langs, ends = t["lang"].take(pa.array(at)).to_pylist(), np.append(at[1:], len(t))
            source, p, p0 = t["source"].to_pylist(), t["p"].to_numpy(), t["p0"].to_numpy()
            for l, a, z in zip(langs, at.tolist(), ends.tolist(), strict=True):
                if z - a < 2:
                    continue
                if l != lang or len(code) + z - a > WIDTH:
                    names = list(code)
                    yield from emit(np.arange(len(code)), np.arange(len(code)), total)
                    lang, code, total = l, {}, np.zeros((0, 0), np.int64)
                run = np.array([code.setdefault(s, len(code)) for s in source[a:z]])
                x, x0 = p[a:z], p0[a:z]
                step = max(1, WIDTH * WIDTH // (z - a))
                wide = len(code) > WIDTH  # one term of more sources than a table of sums may hold goes out by itself, in blocks
                if not wide and len(total) < len(code):
                    total = np.pad(total, (0, len(code) - len(total)))
                for k in range(0, z - a, step):
                    y, y0 = x[k : k + step, None], x0[k : k + step, None]
                    change = _f(y, x) - _f(y, x0) - _f(y0, x) + _f(y0, x0)
                    if wide:
                        names = list(code)
                        yield from emit(run[k : k + step], run, change)
                    else:
                        total[np.ix_(run[k : k + step], run)] += change
                if wide:
                    code, total = {}, np.zeros((0, 0), np.int64)
        names = list(code)
        yield from emit(np.arange(len(code)), np.arange(len(code)), total)

    ordered = _sorted_runs(placed.select("lang", "term", "source", "p", "p0"), ["lang", "term"], ["lang", "term", "source"])
    return ordered.mapInArrow(lean(walk), "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, held: int = HELD) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank; ``top`` terms a group."""
    scratch, empty = Scratch(tune(docs.sparkSession)), F.lit("")
    found = scratch.settle(cells(docs, min_docs, held))
    # One row a group, as the result itself has at least.
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    terms = found.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0)
    groups = scratch.settle(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total") + F.col("terms")))))
    placed = found.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", _share(F.col("n"), F.col("total") + F.col("terms")).alias("p"), "p0",
        _share(F.col("lang_n"), F.col("lang_total") + F.col("terms")).alias("q"))
    placed = scratch.settle(placed)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = placed.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    wide = lambda c: c.cast("decimal(19,0)")
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("item_p0"))
    lone = F.coalesce(wide(F.col("terms") - F.col("held") - F.col("item_held")) * wide(_distance(F.col("p0"), F.col("item_p0"))), F.lit(0))
    base = groups.join(other, "lang").where("source != item").select("lang", "source", "item", lone.alias("value"))
    counts = placed.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).join(other, "lang").where("source != item")
    mine = counts.select("lang", "source", "item", (wide(F.col("k")) * wide(_distance(F.col("p"), F.col("item_p0")))).alias("value"))
    theirs = counts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (wide(F.col("k")) * wide(_distance(F.col("item_p0"), F.col("p")))).alias("value"))
    big = lambda df: df.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    pairs = big(base).union(big(mine)).union(big(theirs)).union(big(shared(placed)))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").union(named(over, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total FROM groups g LEFT JOIN own o USING (lang, source) GROUP BY ALL),
every AS (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (t.total + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v)::HUGEINT AS lang_p
  FROM totals t JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, term AS item, (((p - lang_p) * (p - lang_p)) // lang_p)::BIGINT AS value FROM every WHERE n > 0 AND p > lang_p)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""
