"""Exact top-k inner-product search by M-trees.

Every vector is scaled to whole numbers. A vector x is lifted to (x, sqrt(M - |x|^2)), M the largest squared norm of
all, and a query q to (q, 0); the Euclidean distance of the two is then |q|^2 + M - 2 q.x, so nearest neighbours in that
metric are exactly the highest inner products. The data are dealt by hash into blocks; each block is bulk-loaded into an
M-tree: pages of at most PAGE entries, each routing entry with its centre, covering radius and the distance to its
parent's centre. A query goes through a tree best-first: pages wait in a heap by the best score that they can hold; what the
stored parent distance rules out by the triangle inequality is dropped without computing a distance, and the search
ends when the best waiting page can't reach the k-th score. Leaf entries are scored in whole numbers, so results and ties are exact.

Every block of data meets every query: a stated query set against all rows. A block's rows come first in its task, its
tree is built once, and the queries stream past it; only past QUERIES queries is a block dealt out again. Before that each
query is scored against FLOOR rows chosen by hash, the same for all: its k-th best score there is a floor below which no
candidate counts, so whole pages and blocks are passed over, and only what can still be among the k best leaves a tree.

Defined results: vectors that are null, or hold a null, a NaN or an infinity, take no part; vectors of other lengths
than the query's aren't comparable and are searched apart; a null id takes no part; rows that share an id are separate
candidates, and no row of the query's own id is one of its candidates; rows that ask with the same id and vector are
answered once each; equal scores go to the smaller id; scores are exact however large the components, and one beyond a long is the
nearest long (and ties there); empty vectors score 0 with each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, lean, partitions, tune

K, SCALE, EVERY, PAGE, BLOCK, LEAST, QUERIES, FLOOR = 20, 64, 20, 512, 32768, 4096, 1 << 18, 2048
SLACK, LOW, HIGH = 1e-7, -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray, top: float) -> np.ndarray:
    """Whole numbers held as doubles in a type in which products stay exact; top: a bound on squared norms."""
    if top < 1 << 52:
        return x
    return x.astype(np.int64) if top < 1 << 62 else np.vectorize(int, otypes=[object])(x)


class Node:
    """A page. A routing page holds children, their centres and radii; a leaf page holds its rows' vectors and ids one
    after the other. ``parent`` are the entries' distances to this page's own centre."""

    __slots__ = ("centre", "radius", "children", "vectors", "ids", "parent", "centres", "radii")

    def __init__(self, centre, radius, parent, children=None, vectors=None, ids=None):
        self.centre, self.radius, self.parent, self.children, self.vectors, self.ids = centre, radius, parent, children, vectors, ids
        if children is not None:
            self.centres, self.radii = np.array([c.centre for c in children]), np.array([c.radius for c in children])


class MTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float, page: int = PAGE):
        """x: whole-number vectors; top: a bound on their squared norms."""
        # Doubles hold whole numbers up to 2^53 exactly, and are far faster to multiply; beyond a long Python counts.
        x = x.astype(float)
        self.x, self.ids, self.page, self.top = whole(x, top), ids, page, top
        lift = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))
        self.points = np.hstack([x, lift[:, None]])
        self.root = self._load(np.arange(len(x)))
        self.computed = 0

    def _load(self, rows: np.ndarray) -> Node:
        """Bulk load: rows are split among up to a page of spread-out pivots until they fit a page."""
        p = self.points[rows]
        centre = p.mean(axis=0)
        far = np.sqrt(((p - centre) ** 2).sum(axis=1))
        if len(rows) <= self.page or far.max() == 0.0:
            return Node(centre, far.max(), far, None, self.x[rows], self.ids[rows])
        n = min(self.page, -(-len(rows) // (self.page // 2)))
        nearest = ((p - p[far.argmax()]) ** 2).sum(axis=1)
        owner = np.zeros(len(rows), np.int64)
        for k in range(1, n):  # the next pivot is the point farthest from all pivots so far
            d = ((p - p[nearest.argmax()]) ** 2).sum(axis=1)
            owner[d < nearest] = k
            nearest = np.minimum(nearest, d)
        parts = [rows[owner == k] for k in range(n)]
        parts = [q for q in parts if len(q)]
        if len(parts) < 2:
            return Node(centre, far.max(), far, None, self.x[rows], self.ids[rows])
        children = [self._load(q) for q in parts]
        parent = np.array([np.sqrt(((c.centre - centre) ** 2).sum()) for c in children])
        radius = max(d + c.radius for d, c in zip(parent, children, strict=True))
        return Node(centre, min(radius, far.max()), parent, children)

    def search(self, q: np.ndarray, own: int, k: int = K, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) for a whole-number query, its own id left out, best first; ties to smaller ids.
        floor: a score that k candidates elsewhere are known to reach; less is of no use."""
        point, exact = np.append(q.astype(float), 0.0), whole(q.astype(float), self.top)
        base = float(q @ q) + self.top
        margin = SLACK * (base + 1)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        worst = -np.inf if floor is None or floor <= LOW else floor

        def reach(distance: np.ndarray) -> np.ndarray:
            """The highest score at a distance of at least this."""
            return (base - np.maximum(distance, 0.0) ** 2) / 2 + margin

        away = float(np.sqrt(((point - self.root.centre) ** 2).sum()))
        heap = [(-float(reach(np.array([away - self.root.radius]))[0]), 0, away, self.root)]
        pushed = 1
        while heap:
            bound, _, away, node = heapq.heappop(heap)
            if -bound < worst:
                break
            # Triangle inequality with the stored parent distances, before anything is computed.
            near = np.abs(away - node.parent)
            if node.children is None:
                alive = (reach(near) >= worst) & (node.ids != own)
                every = alive.all()
                scores = (node.vectors if every else node.vectors[alive]) @ exact
                if scores.dtype == object:
                    scores = np.array([min(max(s, LOW), HIGH) for s in scores], np.int64)
                ids = node.ids if every else node.ids[alive]
                self.computed += len(scores)
                if len(best) < k and len(scores) > k:  # no more than the page's k best, and their equals, can enter
                    worst_here = np.partition(scores, len(scores) - k)[len(scores) - k]
                    enter = np.flatnonzero(scores >= max(worst, worst_here))
                else:
                    enter = np.flatnonzero(scores >= worst)
                for s, i in zip(scores[enter].tolist(), ids[enter].tolist(), strict=True):
                    if s < worst:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                    if len(best) == k:
                        worst = max(worst, best[0][0] if best[0][0] > LOW else -np.inf)
                continue
            picked = np.flatnonzero(reach(near - node.radii) >= worst)
            if not len(picked):
                continue
            d = np.sqrt(((node.centres[picked] - point) ** 2).sum(axis=1))
            self.computed += len(picked)
            for c, away_c, r in zip(picked, d, reach(d - node.radii[picked]), strict=True):
                if r >= worst:
                    heapq.heappush(heap, (-float(r), pushed, float(away_c), node.children[c]))
                    pushed += 1
        return [(int(s), -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, whole-number components, length and squared norm of the vectors that take part."""
    def component(c):
        x = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(x) < F.lit(float(1 << 62)), F.floor(x).cast("double")).otherwise(x)  # larger doubles are whole

    v = F.transform("embedding", component)
    sound = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def floors(asks: DataFrame, rows: DataFrame, k: int, top: float, sample: int = FLOOR) -> DataFrame:
    """Adds ``floor`` to the asking rows: the k-th best score among at most ``sample`` rows, the same for every query; null
    where those have fewer than k other rows of the query's length."""
    held = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("vec_id", "v", "dim").limit(sample).collect()  # a bounded number of rows
    by: dict = {}
    for r in held:
        by.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    known = asks.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in x]), np.array([v for _, v in x], np.float64).reshape(len(x), d)) for d, x in by.items()})

    def each(batches):
        for b in batches:
            dims, out = b.column(b.schema.get_field_index("dim")).to_numpy(), [None] * b.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                ids, x = known.value.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                if len(ids) < k:
                    continue
                part = b.take(pa.array(at))
                q = matrix(part.column(b.schema.get_field_index("v")), d)
                scores = q @ x.T
                scores[ids[None, :] == part.column(b.schema.get_field_index("vec_id")).to_numpy()[:, None]] = -np.inf
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                for r, s in zip(at.tolist(), least.tolist(), strict=True):
                    # Below 2^53 doubles are exact; beyond, as much is given away as rounding can add.
                    s -= 0.0 if top < 1 << 52 else top * (d + 2) * 1e-15
                    out[r] = None if s <= LOW else int(min(s, float(1 << 62)))
            yield b.append_column("floor", pa.array(out, pa.int64()))

    return asks.mapInArrow(each, "vec_id long, v array<double>, dim int, times long, ask long, floor long")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score for every vector whose id is divisible by ``every``."""
    spark = tune(vectors.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.settle(scaled(vectors, scale))
    # A vector that asks several times under one id is searched once and answered each time.
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v", "dim").agg(F.count("*").alias("times")).withColumn("ask", F.monotonically_increasing_id())
    stats = rows.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
    top = float(stats["top"] or 0)
    top = top if top < 1 << 52 else top * (1 + 1e-9)  # sums of doubles are rounded
    asks = scratch.settle(floors(asks, rows, k, top))
    q = asks.count()
    # Blocks of a bounded size, and enough of them for all tasks where rows are few.
    blocks = max(1, -(-stats["n"] // block), min(partitions(spark), stats["n"] // least))
    decks = max(1, -(-q // queries))
    # Even blocks: hashed on id and content; a vector that many rows share is spread like any other, equal rows in turn.
    place = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("long")
    data = rows.select(place.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(decks - 1))).alias("deck"), "dim", F.lit(False).alias("asks"), "vec_id", "v", none.alias("floor"), none.alias("ask"))
    asking = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(decks)).cast("int").alias("deck"), "dim", F.lit(True).alias("asks"), "vec_id", "v", "floor", "ask")
    name = ["block", "deck", "dim"]
    # In a task the rows of a block come before those that ask.
    dealt = data.unionByName(asking).repartition(max(partitions(spark), 1), *name).sortWithinPartitions(*name, "asks")

    def answer(batches):
        last, held, tree = None, [], None
        for b in batches:
            keys = [tuple(x) for x in zip(*(b.column(c).to_pylist() for c in name), strict=True)]
            cut = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            out: list[tuple] = []
            for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != last:
                    last, held, tree = keys[lo], [], None
                part = b.slice(lo, hi - lo)
                dim, asked = last[2], part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                own = part.filter(pa.array(~asked))
                if own.num_rows:
                    held.append((matrix(own.column(5), dim), own.column(4).to_numpy()))
                asking = part.filter(pa.array(asked))
                if not asking.num_rows:
                    continue
                if tree is None and held:
                    tree = MTree(np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held]), top)
                    held = []
                if tree is None:
                    continue
                for i, q, f, a in zip(asking.column(4).to_numpy(), matrix(asking.column(5), dim), asking.column(6).to_pylist(), asking.column(7).to_pylist(), strict=True):
                    found = tree.search(q, int(i), k, f)
                    if found:
                        out.append((int(i), a, [{"vec_id": other, "score": s} for s, other in found]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))), strict=True)], names=["query_id", "ask", "found"])

    found = dealt.mapInArrow(lean(answer), "query_id long, ask long, found array<struct<vec_id:long,score:long>>")
    each = found.select("query_id", "ask", F.explode("found").alias("f")).select("query_id", "ask", "f.*")
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    # A query's candidates are k a block at most, and few beyond the floor.
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    again = asks.where("times > 1").select("ask", "times")
    if again.head(1):
        ranked = ranked.join(again, "ask", "left").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), n AS (SELECT row_number() OVER () AS asked, * FROM v
), s AS (
  SELECT asked, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM n q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
