"""Exact top-k inner products by best-first search in M-trees.

Components become floor(1024 * x). Within a tree, vectors x and queries q are lifted to (x, sqrt(M^2 - |x|^2)) and (q, 0),
M the tree's largest norm; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so nearest in a metric is highest in score. Every row is
dealt to the nearest of at most PIVOTS pivots (farthest-first in a sample of SAMPLE rows), and a pivot's rows to trees
of about TREE_ROWS rows, so that a common vector fills many trees. A tree is one row of a written table: its root and the root's covering
radius; pages of PAGE vectors, each with its routing vector, covering radius and distance to the root; and every vector's distance to its
page's routing vector. A search keeps pages in a queue by their bound: first from the stored parent distance, which costs no distance
computation, then from the page's own distance; within a page stored distances rule vectors out. Bounds have a margin for
rounding, scores are exact integers.

Each query first searches the tree that holds it; its k-th score there is a bound that lets the other trees drop pages and
results. Then blocks of QUERY_BLOCK queries meet all trees in one equality join on a group of trees, each block being sent to every
group; trees, blocks and groups have fixed sizes, and only their numbers follow the table.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths are not compared; rows that repeat an id are queries and candidates each, and only a query's own row is no candidate of
it; scores beyond a long end at its limits. An empty table gives an empty result. Only vec_id and embedding are read, so other columns
do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, keep, parts_for

SCALE, EVERY, K = 1024, 100, 10
SAMPLE, PIVOTS, PAGE, TREE_ROWS, QUERY_BLOCK, GROUP_TREES = 4096, 256, 128, 2048, 2048, 64
_LONG = 2**63 - 1
_NONE = -_LONG - 1  # no bound yet


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id, dim, v: floored components as doubles, which hold them exactly."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    big = F.transform("embedding", lambda c: c.cast("double") * SCALE)  # beyond 2**52 every double is whole
    v = F.zip_with(x, big, lambda a, b: F.when(F.abs(b) < 2.0**52, a).otherwise(b))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v"))


def _farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of up to k pivots, each farthest from those before; fewer if vectors repeat."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)


#: What a tree's row holds: the kind of its numbers, and how many columns they have (0: none, 1: the vectors', 2: one more).
STORED = {"rows": ("<i8", 0), "ids": ("<i8", 0), "x": ("<f8", 1), "start": ("<i8", 0), "route": ("<f8", 2), "radius": ("<f8", 0), "to_root": ("<f8", 0), "to_route": ("<f8", 0), "root": ("<f8", 0), "whole": ("<f8", 0)}


class Tree:
    """Pages of one tree. Arrays are ordered by page; start has each page's first row and the end; whole is the root's radius, the
    largest squared norm and the largest component."""

    def __init__(self, **stored: np.ndarray) -> None:
        self.rows, self.ids, self.x, self.start, self.route, self.radius, self.to_root, self.to_route, self.root, whole = (stored[n] for n in STORED)
        self.whole, self.most, self.top = whole.tolist()

    @classmethod
    def load(cls, row: dict, dim: int) -> Tree:
        tree = {n: np.frombuffer(row[n], kind) for n, (kind, _) in STORED.items()}
        return cls(**{n: x.reshape(-1, dim + STORED[n][1] - 1) if STORED[n][1] else x for n, x in tree.items()})

    def search(self, q: np.ndarray, own: int, k: int, floor: int = _NONE) -> list[tuple[int, int]]:
        """(score, -vec_id) of the k best rows but row own, of scores not below floor."""
        best: list[tuple[int, int]] = []
        qq = float(q @ q)
        slack = 1e-9 * (qq + self.most) + 1.0
        lift = np.append(q, 0.0)
        exact = float(np.abs(q).max()) * self.top * len(q) < 2.0**52

        def reach() -> float:
            """Greatest distance at which a vector can still count."""
            least = max(best[0][0], floor) if len(best) == k else floor
            return np.inf if least == _NONE else np.sqrt(max(qq + self.most - 2.0 * least + slack, 0.0))

        d0 = float(np.sqrt(((lift - self.root) ** 2).sum()))
        if d0 - self.whole > reach():
            return best
        bound = np.maximum(np.abs(d0 - self.to_root) - self.radius, 0)
        queue = [(b, -1.0, i) for i, b in enumerate(bound.tolist())]
        heapq.heapify(queue)
        while queue:
            b, d, i = heapq.heappop(queue)
            r = reach()
            if b > r:
                break
            if d < 0:
                d = float(np.sqrt(((lift - self.route[i]) ** 2).sum()))
                if (own_bound := max(d - self.radius[i], 0.0)) <= r:
                    heapq.heappush(queue, (max(b, own_bound), d, i))
                continue
            a, z = self.start[i], self.start[i + 1]
            near = np.abs(d - self.to_route[a:z]) <= r
            near &= self.rows[a:z] != own
            ids, x = self.ids[a:z][near], self.x[a:z][near]
            if exact:
                scores = (x @ q).astype(np.int64).tolist()
            else:
                whole = [int(c) for c in q]
                scores = [max(_NONE, min(_LONG, sum(int(c) * w for c, w in zip(row, whole)))) for row in x]
            for s, v in zip(scores, ids.tolist()):
                if s >= floor:
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
        return best


def build(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """What ``Tree`` takes, of vectors x, their ids and the numbers of their rows."""
    norms = (x * x).sum(axis=1)
    most = float(norms.max())
    lifted = np.column_stack([x, np.sqrt(np.maximum(most - norms, 0))])
    pivots = lifted[_farthest_first(lifted, -(-len(x) // PAGE))]
    at = _nearest(lifted, pivots)
    order = np.lexsort((rows, ids, at))
    full = [int(n) for n in np.unique(at, return_counts=True)[1]]
    start = np.concatenate([[0], np.cumsum([min(PAGE, n - i) for n in full for i in range(0, n, PAGE)])]).astype("<i8")  # a full page is split
    lifted, at = lifted[order], at[order]
    root, route = lifted.mean(axis=0), pivots[at[start[:-1]]]
    to_route = np.sqrt(((lifted - pivots[at]) ** 2).sum(axis=1))
    whole = np.array([np.sqrt(((lifted - root) ** 2).sum(axis=1)).max(), most, np.abs(x).max()])
    return {
        "rows": rows[order], "ids": ids[order], "x": x[order], "start": start, "route": route, "radius": np.maximum.reduceat(to_route, start[:-1]),
        "to_root": np.sqrt(((route - root) ** 2).sum(axis=1)), "to_route": to_route, "root": root, "whole": whole,
    }


def _trees(table: DataFrame) -> DataFrame:
    """dim and what STORED names: a row for each tree."""
    vectors = keep(_vectors(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).toPandas()
    pivots = {int(d): (x := np.array(g["v"].tolist()))[_farthest_first(x, min(PIVOTS, max(1, n // (TREE_ROWS // 2))))] for d, g in sample.groupby("dim")}

    @F.arrow_udf(T.IntegerType())
    def nearest(dims: pa.Array, vs: pa.Array) -> pa.Array:
        out = np.full(len(dims), -1, np.int32)
        d = np.array(dims)
        for dim, p in pivots.items():
            rows = (d == dim).nonzero()[0]
            if len(rows):
                out[rows] = _nearest(np.array(vs.take(pa.array(rows)).flatten()).reshape(-1, dim), p)
        return pa.array(out)

    dealt = keep(vectors.withColumn("pivot", nearest("dim", "v")), "vectors-dealt")
    regions = keep(dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / TREE_ROWS).alias("trees")), "regions")
    parted = join_small(dealt, regions, ["dim", "pivot"], "inner").withColumn("part", F.pmod(F.xxhash64("row"), F.col("trees")))

    def pack(key, table):
        ids, x = np.array(table.column("vec_id").combine_chunks()), np.array(table.column("v").combine_chunks().flatten()).reshape(-1, key[0].as_py())
        tree = build(np.array(table.column("row").combine_chunks()).astype("<i8"), ids.astype("<i8"), x.astype("<f8"))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([np.ascontiguousarray(tree[c]).tobytes()], pa.binary()) for c in STORED})

    return keep(parted.groupBy("dim", "pivot", "part").applyInArrow(pack, "dim int, " + ", ".join(f"{c} binary" for c in STORED)), "trees")


def top_k(table: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row whose vec_id is divisible by EVERY (rows vec_id, embedding)."""
    trees = _trees(table)
    spark = trees.sparkSession

    def own(batches):
        """Each query with its k-th score in its own tree."""
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.load(row, row["dim"])
                asked = (tree.ids % EVERY == 0).nonzero()[0]
                floors = [min(found)[0] if len(found := tree.search(tree.x[a], int(tree.rows[a]), k)) == k else _NONE for a in asked]
                n = len(asked)
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * n, pa.int32()), pa.array(tree.rows[asked]), pa.array(tree.ids[asked]), pa.array(floors, pa.int64()), pa.array([tree.x[a].tobytes() for a in asked], pa.binary())], names=["dim", "row", "query_id", "floor", "q"])

    asked = keep(trees.mapInArrow(own, "dim int, row long, query_id long, floor long, q binary"), "queries")
    blocks, groups = -(-asked.count() // QUERY_BLOCK), parts_for(spark, trees.count(), GROUP_TREES)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))))

    def pack(key, table):
        whole = lambda c: table.column(c).to_numpy().astype("<i8").tobytes()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([whole(c)], pa.binary()) for c in ("row", "query_id", "floor")}, "q": pa.array([b"".join(table.column("q").to_pylist())], pa.binary())})

    packed = keep(numbered.groupBy("dim", "block").applyInArrow(pack, "dim int, row binary, query_id binary, floor binary, q binary"), "query-blocks")
    sent = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = trees.withColumn("group", F.pmod(F.xxhash64("ids", "rows"), F.lit(groups)).cast("int")).join(sent.hint("shuffle_merge"), ["dim", "group"])

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.load(row, row["dim"])
                own, ids, floors = (np.frombuffer(row[c], "<i8").tolist() for c in ("row", "query_id", "floor"))
                rows = [(a, i, -v, s) for a, i, floor, q in zip(own, ids, floors, np.frombuffer(row["q"], "<f8").reshape(-1, row["dim"])) for s, v in tree.search(q, a, k, floor)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 4], names=["row", "query_id", "vec_id", "score"])

    found = keep(met.mapInArrow(search, "row long, query_id long, vec_id long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v AS q JOIN v AS c ON c.own <> q.own AND len(c.e) = len(q.e) WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= {K}
"""
