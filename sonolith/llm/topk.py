"""Exact top-k by inner product: a ball tree per shard, branch and bound, shared kth scores.

Vectors become integers, floor(1024 * x). Each shard is one ball tree, built once, past which the
queries go in blocks. Shards are searched in waves, few at first: after each wave the kth scores of
all queries are shared, and in the next wave a node is only entered if its inner-product bound
reaches the kth score that the query has by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import cut, named

SCALE, K = 1024, 10
#: Rows of a leaf, queries of a block, rows of a shard.
LEAF, BLOCK, SHARD_ROWS = 64, 512, 8192
#: Share of the shards that have been searched after each wave.
WAVES = (1 / 16, 1 / 4, 1.0)
_LEAST = np.iinfo(np.int64).min
_EXACT = float(1 << 52)


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component, x as double; null for vectors that are null or hold null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    return F.when(vector.isNull() | (F.size(vector) == 0) | F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(whole)


class BallTree:
    """Rows in order of leaves; each leaf a ball, each inner node a ball over two nodes."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left child, right child (-1: leaf)
        centres, radii = [], []
        x = vectors.astype(np.float64)
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            rows = x[self.order[a:b]]
            centre = rows.mean(axis=0)
            far = ((rows - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            self.nodes.append((a, b, -1, -1))
            if parent >= 0:
                f, t, left, right = self.nodes[parent]
                self.nodes[parent] = (f, t, me, right) if side == 0 else (f, t, left, me)
            if b - a > leaf and radii[-1] > 0:
                one = rows[int(far.argmax())]
                two = rows[int(((rows - one) ** 2).sum(axis=1).argmax())]
                along = rows @ (two - one)
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
                todo += [(a + middle, b, me, 1), (a, a + middle, me, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def leaves_by_bound(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and their bounds for each query (-inf where a node above them is below the floor)."""
        norm = np.sqrt((queries**2).sum(axis=1))
        bound = queries @ self.centres.T + norm[:, None] * self.radii[None, :]
        bound += 1e-9 * np.abs(bound) + 1e-6
        live = bound >= floor[:, None]
        for i, (_, _, left, right) in enumerate(self.nodes):
            if left >= 0:
                live[:, left] &= live[:, i]
                live[:, right] &= live[:, i]
        leaves = np.array([i for i, n in enumerate(self.nodes) if n[2] < 0])
        return leaves, np.where(live[:, leaves], bound[:, leaves], -np.inf)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search(tree: BallTree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score): the best k of a shard for each query, none below the query's floor."""
    kth = floor.copy()
    leaves, bound = tree.leaves_by_bound(queries.astype(np.float64), kth.astype(np.float64))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_q, best_id, best_s = (np.zeros(0, np.int64) for _ in range(3))
    line = np.arange(len(queries))[:, None]
    rank, step = 0, 1
    while rank < len(leaves):  # best leaves first, twice as many each time
        at = order[:, rank : rank + step]
        rank, step = rank + step, 2 * step
        on_q, on_r = np.nonzero(bound[line, at] >= np.where(kth == _LEAST, -np.finfo(np.float64).max, kth.astype(np.float64))[:, None])
        if not len(on_q):
            break
        new = []
        by_leaf = np.argsort(at[on_q, on_r], kind="stable")
        on_q, on_leaf = on_q[by_leaf], at[on_q, on_r][by_leaf]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(on_leaf)) + 1, [len(on_leaf)]))
        for first, last in zip(edge[:-1], edge[1:], strict=True):
            mine = on_q[first:last]
            a, b, _, _ = tree.nodes[leaves[on_leaf[first]]]
            rows = tree.order[a:b]
            s = _scores(queries[mine], vectors[rows])
            ok = (s >= kth[mine][:, None]) & (ids[rows][None, :] != query_ids[mine][:, None])
            q, r = np.nonzero(ok)
            new.append((mine[q], ids[rows][r], s[q, r]))
        q, i, s = (np.concatenate(x) for x in zip(*new, strict=True))
        q, i, s = np.concatenate([best_q, q]), np.concatenate([best_id, i]), np.concatenate([best_s, s])
        sort = np.lexsort((i, -s, q))
        q, i, s = q[sort], i[sort], s[sort]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        held = place < k
        best_q, best_id, best_s, place = q[held], i[held], s[held], place[held]
        full = place == k - 1
        kth[best_q[full]] = np.maximum(kth[best_q[full]], best_s[full])
    return best_q, best_id, best_s


def _packed(rows: DataFrame, rows_each: int) -> DataFrame:
    """Rows (id, v, floor) as blocks of ``rows_each`` at most: dim, ids, v, floors as binary int64."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray, int]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, v, floors = zip(*waiting.pop(dim), strict=True)
            parts = [np.array(ids, dtype="<i8"), np.stack(v).astype("<i8"), np.array(floors, dtype="<i8")]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["dim", "ids", "v", "floors"])

        for b in batches:
            values, offsets = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            for i, low, high, floor in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column(2).to_pylist(), strict=True):
                have = waiting.setdefault(high - low, [])
                have.append((i, values[low:high], floor))
                if len(have) >= rows_each:
                    yield block(high - low)
        for dim in list(waiting):
            yield block(dim)

    return rows.mapInArrow(work, "dim int, ids binary, v binary, floors binary")


def _search_shards(rows: DataFrame, k: int) -> DataFrame:
    """Over rows (dim, s, block, ids, v, floors), a shard (not block) before the blocks that it is asked: query_id, vec_id, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                v = np.frombuffer(r["v"], "<i8").reshape(len(ids), -1)
                if not r["block"]:
                    shard = (BallTree(v), ids, v)
                    continue
                at, vec, s = search(*shard, ids, v, np.frombuffer(r["floors"], "<i8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(s)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(work, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, waves: tuple[float, ...] = WAVES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products over all other rows, all if fewer.

    ``is_query`` is a condition on the id column. Ties go to the lesser vec_id. Vectors that are
    null, empty, or hold a null or non-finite component take no part, nor do rows without an id;
    rows that share the query's id are its own and not found; of several vectors with its id the
    least one asks. Vectors meet those of their own length only. Repeated rows are found repeatedly.
    Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    rows = named(df, id_col, vector_col).withColumn("q", is_query).toDF("id", "vec", "q")
    rows = rows.select(F.col("id").cast("long").alias("id"), quantised(F.col("vec")).alias("v"), "q").where("v is not null and id is not null")
    least = F.lit(int(_LEAST)).cast("long")
    shards = cut(_packed(rows.select("id", "v", least.alias("floor")), shard_rows)).withColumn("n", F.monotonically_increasing_id())
    numbers = shards.select("n", "dim").withColumn("s", F.row_number().over(Window.partitionBy("dim").orderBy("n")) - 1)
    shards = shards.join(numbers.select("n", "s"), "n").select("dim", "s", "ids", "v", "floors")
    per_dim = cut(numbers.groupBy("dim").agg(F.count(F.lit(1)).alias("shards")))
    asked = cut(rows.where("q").groupBy("id").agg(F.min("v").alias("v")))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    most = per_dim.agg(F.sum("shards")).first()[0] or 1
    best = df.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    for low, high in zip((0.0, *waves[:-1]), waves, strict=True):
        # a query has a kth score only once it has k
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        queries = asked.join(kth, "id", "left").select("id", "v", F.coalesce("floor", least).alias("floor"))
        blocks = _packed(queries.repartition(n_blocks, "id"), BLOCK).join(F.broadcast(per_dim), "dim")  # one row for each length of vector
        first, last = (F.ceil(F.col("shards") * F.lit(x)).cast("int") for x in (low, high))
        blocks = blocks.select("dim", F.explode(F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))).alias("s"), F.lit(True).alias("block"), "ids", "v", "floors")
        wave = shards.join(F.broadcast(per_dim), "dim").where((F.col("s") >= first) & (F.col("s") < last))
        both = wave.select("dim", "s", F.lit(False).alias("block"), "ids", "v", "floors").unionByName(blocks)
        each = both.repartition(max(1, round(most * (high - low))), "dim", "s").sortWithinPartitions("dim", "s", "block")
        best = cut(_best(best.drop("rank").unionByName(_search_shards(each, k)), k))
    return best.select("query_id", "rank", "vec_id", "score")
