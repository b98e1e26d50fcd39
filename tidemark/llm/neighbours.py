"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then placed in a leaf. A query walks the tree through a
priority queue of unopened branches, best first, and visits as many leaves as calibration found to be needed
for the wanted recall. Inside the visited leaves the search is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import groups_of, stored, table

#: Bounds of the fit and of the calibration, in rows; branches of a node; vectors of the sample in a leaf.
SAMPLE_ROWS, CALIBRATION_QUERIES, BRANCHES, LEAF_ROWS = 20_000, 200, 8, 160
TARGET_RECALL = 0.97
#: Vectors of one block in a task, and queries that meet it there.
BLOCK_ROWS, QUERY_ROWS = 4_096, 4_096


class Tree:
    """Nodes in arrays: center, radius (root mean square distance), children or a leaf number."""

    def __init__(self) -> None:
        self.centers: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0

    def grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.centers)
        center = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        self.centers.append(center)
        self.radius.append(float(np.sqrt(((points - center) ** 2).sum(axis=1).mean())) if len(points) else 0.0)
        self.children.append([])
        self.leaf.append(-1)
        parts = split(points, rng) if len(points) > LEAF_ROWS else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            for part in parts:
                self.children[node].append(self.grow(part, rng))
        return node

    def frozen(self) -> Tree:
        self.matrix = np.array(self.centers)
        self.spread = np.array(self.radius)
        return self

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest center at each level."""
        out = np.zeros(len(vectors), np.int32)
        open_nodes = [(0, np.arange(len(vectors)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.matrix[kids]
            near = np.argmin((c**2).sum(axis=1)[None, :] - 2 * vectors[rows] @ c.T, axis=1)
            open_nodes += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves in best-bin-first order: inner product with the center, plus its spread."""
        length = float(np.sqrt(query @ query))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                continue
            bound = self.matrix[kids] @ query + 0.5 * length * self.spread[kids]
            for kid, value in zip(kids, bound):
                heapq.heappush(queue, (-float(value), kid))
        return out


def split(points: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
    """k-means parts that are not empty; one part if all points agree."""
    distinct = np.unique(points, axis=0)
    if len(distinct) < 2:
        return [points]
    centers = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T, axis=1)
        centers = np.array([points[near == i].mean(axis=0) for i in range(len(centers)) if (near == i).any()])
    near = np.argmin((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T, axis=1)
    return [points[near == i] for i in range(len(centers)) if (near == i).any()]


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def best(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best, ties to smaller ids.

    The matrix product only shortlists, with a margin for its rounding; the score itself is summed the same way
    for every row, so equal vectors have equal scores.
    """
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        short = np.flatnonzero(scores >= kth - 1e-9 * max(1.0, abs(kth)))
    else:
        short = np.arange(len(scores))
    exact = (vectors[short] * query[None, :]).sum(axis=1)
    order = np.lexsort((ids[short], -exact))[:k]
    return ids[short][order], exact[order]


PARTIAL = "query_id long, vec_id long, score double"


def search_blocks(k: int):
    """Best k of a block of vectors for a chunk of the queries that came to it; a group holds both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["leaf", "block", "chunk"]):
            ids = group.column("id").to_numpy()
            asks = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            vectors = matrix_of(group.column("vector"))
            rows, rows_ids = vectors[~asks], ids[~asks]
            q, q_ids = vectors[asks], ids[asks]
            out = ([], [], [])
            for start in range(0, len(q), 256):
                products = q[start : start + 256] @ rows.T
                for i, scores in enumerate(products):
                    own = q_ids[start + i]
                    other = rows_ids != own
                    if not other.all():
                        found, exact = best(scores[other], rows_ids[other], rows[other], q[start + i], k)
                    else:
                        found, exact = best(scores, rows_ids, rows, q[start + i], k)
                    out[0].append(np.full(len(found), own))
                    out[1].append(found)
                    out[2].append(exact)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.float64())], ["query_id", "vec_id", "score"])
    return run


def dealt(placed: DataFrame, visited: DataFrame, asking: DataFrame) -> DataFrame:
    """Rows leaf, block, chunk, ask, id, vector: a leaf's vectors in blocks, its queries in chunks, each pair once.

    placed has id, leaf and vector, visited the id and leaf of each visit, asking id and vector. A group holds
    about BLOCK_ROWS vectors and QUERY_ROWS queries, however many of either a leaf has.
    """
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    chunks = visited.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    # One row for each leaf of a tree fitted on a bounded sample: never more than its number of leaves.
    met = F.broadcast(blocks.join(chunks, "leaf"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = visited.join(asking.select("id", "vector"), "id").join(met, "leaf").select("leaf", numbers("blocks").alias("block"), F.pmod(F.xxhash64("id", F.lit("ask")), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("ask"), "id", "vector")
    held = placed.join(met, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), numbers("chunks").alias("chunk"), F.lit(False).alias("ask"), "id", "vector")
    return asked.unionByName(held)


def top(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cleaned(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of usable rows with the most common number of components; repeated ids keep their largest vector."""
    good = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    return good.groupBy("id").agg(F.max("vector").alias("vector"))


def fit_tree(placed: DataFrame, rows: int, total: int) -> Tree:
    """Fit on about SAMPLE_ROWS vectors drawn by a digest of the id; the sample comes to the driver (10 MB at 64 components)."""
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = placed.filter(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1_000_003)) <= int(share * 1_000_003)).orderBy("id").toArrow()
    tree = Tree()
    points = matrix_of(sample.column("vector"))
    tree.grow(points if points.size else np.zeros((1, 1)), np.random.default_rng(11))
    return tree.frozen()


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = TARGET_RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found with the largest inner product, the query's own left out.

    `queries` is a condition on the column `id`. Rows whose vector is null, zero or not finite, or whose id is
    null, take no part; vectors should have one length, others than the most common length take no part either.
    Repeated ids count once. Ties go to the smaller id. An empty table gives an empty result.

    Leaves larger than a block are dealt in blocks by a digest of the id, so a leaf that holds a third of all
    rows is spread; a query goes to every block of a leaf it visits and each block returns k rows at most. The
    queries of a leaf are dealt in chunks, and each block meets each chunk in a group of its own.
    """
    rows = cleaned(vectors, id_column, vector_column)
    held = stored(rows.withColumn("length", F.size("vector")), "vectors")
    lengths = held.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    length, total = (lengths[0]["length"], lengths[0]["count"]) if lengths else (0, 0)
    held = held.filter(F.col("length") == length).select("id", "vector")
    tree = held.sparkSession.sparkContext.broadcast(fit_tree(held, SAMPLE_ROWS, total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tree.value.place(matrix_of(batch.column("vector"))), pa.int32()), batch.column("vector")], ["id", "leaf", "vector"])

    placed = stored(held.mapInArrow(place, "id long, leaf int, vector array<double>"), "leaves")

    def answers(asking: DataFrame, most: int, all_leaves: bool = False) -> DataFrame:
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = matrix_of(batch.column("vector"))
                    found = [tree.value.visits(v, tree.value.leaves if all_leaves else most) for v in q]
                    take = pa.array(np.repeat(np.arange(len(q)), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(take), pa.array([x for f in found for x in f], pa.int32())], ["id", "leaf"])

        visited = stored(asking.select("id", "vector").mapInArrow(visit, "id long, leaf int"), "visits")
        groups = dealt(placed, visited, asking).repartition("leaf", "block", "chunk").sortWithinPartitions("leaf", "block", "chunk")
        return groups.mapInArrow(search_blocks(k), PARTIAL)

    asking = placed.filter(queries)
    n_queries = max(asking.count(), 1)
    share = min(1.0, CALIBRATION_QUERIES / n_queries)
    drawn = asking.filter(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(1_000_003)) <= int(share * 1_000_003))
    leaf_of = placed.select(F.col("id").alias("vec_id"), "leaf")
    truth = top(answers(drawn, 0, all_leaves=True), k).join(leaf_of, "vec_id").select("query_id", "leaf")
    return top(answers(asking, needed_visits(tree.value, truth, drawn, recall)), k)


def needed_visits(tree: Tree, truth: DataFrame, drawn: DataFrame, recall: float) -> int:
    """Fewest leaves that hold the wanted part of the exact neighbours of the calibration queries.

    Widens the visit from one leaf on. At most CALIBRATION_QUERIES queries and their k neighbours are looked at.
    """
    queries = drawn.select("id", "vector").toArrow()
    order = {i: {leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(queries.column("id").to_pylist(), matrix_of(queries.column("vector")))}
    reached = np.sort([order[r["query_id"]][r["leaf"]] for r in truth.collect()])
    if not len(reached):
        return 1
    return int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op9_nearest_neighbours": op9_nearest_neighbours}
