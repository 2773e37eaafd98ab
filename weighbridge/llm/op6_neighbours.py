"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue, then exact reranking.

1. Rows that repeat count once. Equal vectors become one item with the smallest K + 1 of their ids; more can't be among the
   K nearest with ties to the smaller id. Row numbers are cut before the shuffle, so a vector that a third of all rows hold
   is K + 1 rows a task.
2. TREES trees are fitted on at most about SAMPLE items, by a hash of the vector. A node splits its sample at the median
   of the projection on the line through two of its points; a leaf holds about LEAF items of the whole table.
3. Every item goes to its leaf in each tree. Leaves are counted; leaves of over CHUNK items are cut, and leaves and cuts are
   dealt to groups of about GATHERED items.
4. For each distinct query vector all trees are searched at once: the branch with the smallest margin is opened next,
   until SEARCH items, or SHARE of all, are reached. The query then meets the items of these leaves, in double precision.
5. The K nearest of all leaves are kept by (distance, id).

Vectors that are null, zero, empty, of another length than most, or hold null or non-finite components take no part;
null ids take no part. Rows with one id and several vectors count as several candidates of that id; the nearest counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weighbridge.llm import common

K = 10
TREES = 16
LEAF = 256
SAMPLE = 20_000
#: A search ends when its leaves hold so many items, or this share of all items if that is more. Vectors without structure
#: in 64 dimensions need such a share for a recall of 0.9; clustered ones need far less.
SEARCH = 6_000
SHARE = 0.85
CHUNK = 4_096
#: Items of all trees that meet their queries in one group: a query returns its nearest of a group, not of each leaf.
GATHERED = 32_768
QUERY_EVERY = 100
SEED = 20


class Forest:
    """Nodes of all trees in arrays; a child c >= 0 is a node, c < 0 is leaf -1 - c."""

    def __init__(self, sample: np.ndarray, leaf: float, trees: int = TREES, seed: int = SEED) -> None:
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]
        width = sample.shape[1] if len(sample) else 1
        self.normals = np.array(self.normals).reshape(-1, width)
        self.cuts, self.children = np.array(self.cuts), np.array(self.children, np.int64).reshape(-1, 2)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        if len(at) <= max(2.0, leaf):
            return self._leaf()
        for _ in range(8):
            a, b = x[rng.choice(at, 2, replace=False)]
            norm = np.linalg.norm(a - b)
            if norm > 0:
                projected = x[at] @ ((a - b) / norm)
                cut = float(np.median(projected))
                right = projected > cut
                if right.any():
                    break
        else:
            return self._leaf()
        node = len(self.cuts)
        self.normals.append((a - b) / norm)
        self.cuts.append(cut)
        self.children.append([0, 0])
        low = self._grow(x, at[~right], leaf, rng)
        high = self._grow(x, at[right], leaf, rng)
        self.children[node] = [low, high]
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(inner := np.flatnonzero(at >= 0)):
                nodes = at[inner]
                far = np.einsum("ij,ij->i", x[inner], self.normals[nodes]) > self.cuts[nodes]
                at[inner] = self.children[nodes, far.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, enough: int) -> list[list[int]]:
        """Leaves to visit for each row: best margin first over all trees, until they hold enough items."""
        margins = x @ self.normals.T - self.cuts if len(self.cuts) else np.zeros((len(x), 0))
        out = []
        for own in margins:
            queue = [(-np.inf, root) for root in self.roots]
            heapq.heapify(queue)
            leaves, held = [], 0
            while queue and held < enough:
                worst, at = heapq.heappop(queue)
                while at >= 0:
                    m = own[at]
                    near, other = (1, 0) if m > 0 else (0, 1)
                    heapq.heappush(queue, (max(worst, abs(m)), int(self.children[at, other])))
                    at = int(self.children[at, near])
                leaves.append(-1 - at)
                held += int(sizes[-1 - at])
            out.append(leaves)
        return out


def nearest(queries: np.ndarray, items: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest distinct ids by (distance, id), distances exactly in double precision."""
    rough = (items * items).sum(axis=1)[None, :] - 2.0 * (queries @ items.T)
    out = []
    for q, row in zip(queries, rough, strict=True):
        best: dict[int, float] = {}
        wanted = k
        while True:
            if len(row) > wanted:
                limit = np.partition(row, wanted - 1)[wanted - 1]
                chosen = np.flatnonzero(row <= limit + 1e-9 * (1.0 + abs(limit) + float(q @ q)))
            else:
                chosen = np.arange(len(row))
            gap = items[chosen] - q
            far = np.sqrt((gap * gap).sum(axis=1))
            for d, c in zip(far.tolist(), chosen, strict=True):
                for i in ids[c]:
                    best[i] = min(d, best.get(i, d))
            if len(best) >= k or len(row) <= wanted:
                break
            wanted *= 4  # those so far are of too few ids
        out.append(sorted((d, i) for i, d in best.items())[:k])
    return out


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def search(vectors: DataFrame, queries, key: str = "vec_id", embedding: str = "embedding", k: int = K, sample: int = SAMPLE, enough: int = SEARCH, share: float = SHARE, leaf: int = LEAF, trees: int = TREES) -> DataFrame:
    """For each row of vectors that meets the condition `queries` (a Column), its k nearest other rows:
    query_id, rank (from 1), vec_id, score (the distance)."""
    spark = vectors.sparkSession
    common.lean(spark)
    kept = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast(kept).alias("v"), queries.alias("asks"))
    x = x.where("id is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(double(c)) < double('Infinity')) and exists(v, c -> c <> 0)")
    wide = (x.groupBy(F.size("v").alias("wide")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wide").limit(1).collect() or [[0]])[0][0]
    x = x.where(F.size("v") == wide)
    numbered = x.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    items = common.written(numbered.groupBy("v").agg(F.collect_list("id").alias("ids")).withColumn("item", F.monotonically_increasing_id()), "items")
    total = items.count()
    draw = F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(2**53))
    drawn = items.where(draw < min(1.0, sample / max(1, total))).select("v").toPandas()["v"]  # at most about `sample` vectors
    points = np.array(drawn.tolist(), np.float64).reshape(-1, max(1, wide))
    forest = spark.sparkContext.broadcast(Forest(points, leaf * len(points) / max(1, total), trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = forest.value.place(matrix(b.column("v"), wide))
            for t in range(leaves.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(leaves[:, t], pa.int64()), b.column("item"), b.column("v"), b.column("ids")], ["leaf", "item", "v", "ids"])

    placed = items.mapInArrow(place, "leaf long, item long, v " + kept + ", ids array<long>")
    counted = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    found = np.zeros(max(1, forest.value.leaves), np.int64)
    for r in counted.collect():  # leaves of all trees, bounded by the sample
        found[r["leaf"]] = r["n"]
    sizes = spark.sparkContext.broadcast(found)
    chunks = spark.sparkContext.broadcast(np.maximum(1, -(-found // CHUNK)))

    buckets = max(1, -(-total * trees // GATHERED))

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (common.mixed(keys) % np.uint64(buckets)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = b.column("leaf").to_numpy()
            part = common.mixed(b.column("item").to_numpy()) % chunks.value[leaves].astype(np.uint64)
            keys = leaves << 24 | part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys)), pa.array(keys), b.column("v"), b.column("ids")], ["bucket", "key", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                rows: list[tuple[int, int, list[int]]] = []
                for n, own in enumerate(forest.value.search(matrix(c.column("v"), wide), sizes.value, max(enough, int(share * total)))):
                    keys = np.array([leaf_ << 24 | part for leaf_ in own for part in range(int(chunks.value[leaf_]))], np.int64)
                    at = bucket_of(keys)
                    rows += [(int(k), n, keys[at == k].tolist()) for k in np.unique(at)]
                if rows:
                    where, n, keys = (list(z) for z in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), c.column("q").take(pa.array(n)), c.column("v").take(pa.array(n)), pa.array(keys, pa.list_(pa.int64()))], ["bucket", "q", "v", "keys"])

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not (asked.num_rows and there.num_rows):
            return schema.empty_table()
        keys = there.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        items, ids = matrix(there.column("v").combine_chunks(), wide)[order], there.column("ids").to_pylist()
        ids = [ids[i] for i in order]
        found, starts = np.unique(keys[order], return_index=True)
        ends = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True), strict=True))
        queries_ = matrix(asked.column("v").combine_chunks(), wide)
        by_key: dict[int, list[int]] = {}
        for n, own in enumerate(asked.column("keys").to_pylist()):
            for key_ in own:
                by_key.setdefault(key_, []).append(n)
        best_: list[dict[int, float]] = [{} for _ in range(asked.num_rows)]
        for key_, those in by_key.items():
            if key_ in ends:
                a, z = ends[key_]
                for n, got in zip(those, nearest(queries_[those], items[a:z], ids[a:z], k + 1), strict=True):
                    for d, i in got:
                        best_[n][i] = min(d, best_[n].get(i, d))
        top = [sorted((d, i) for i, d in own.items())[: k + 1] for own in best_]
        n = pa.array([n for n, own in enumerate(top) for _ in own], pa.int64())
        return pa.table([asked.column("q").combine_chunks().take(n), pa.array([i for own in top for _, i in own], pa.int64()), pa.array([d for own in top for d, _ in own], pa.float64())], schema=schema)

    asked = x.where("asks").select(F.col("id").alias("query_id"), "v")
    distinct = common.written(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    asking = distinct.mapInArrow(ask, "bucket long, q long, v " + kept + ", keys array<long>")
    dealt = placed.mapInArrow(deal, "bucket long, key long, v " + kept + ", ids array<long>")
    met = asking.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(meet, "q long, id long, score double")
    best = met.groupBy("q", "id").agg(F.min("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= k + 1).drop("n")
    out = asked.join(distinct, "v").select("query_id", "q").join(best, "q").where("id <> query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)
