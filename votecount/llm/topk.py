"""Exact top-k search by inner product: ball trees per shard, branch and bound, one kth score for all.

1. A bounded sample of rows gives the top of a ball tree: up to ``CELLS`` cells, in tree order.
   Every row goes to its nearest cell; cells are dealt to *shards* of rows and, for the asking rows,
   to *blocks* of queries. A cell with more rows than a shard holds (a hot vector, say) is spread
   over several shards by hash, small neighbouring cells share one. So shards and blocks are balls
   of near vectors and none grows with the data.
2. Each shard builds its ball tree in one task and is kept as one row of arrays.
3. A block of queries meets the shards in the order of the largest inner product that the two balls
   allow: first the best shard, then the next eight, then 64 and so on. Every round starts from the
   kth scores found so far over all shards, so a pair of block and shard, and inside it a node and a
   query, is left out once its bound is below them. Within a group of shards the kth score is
   handed on from tree to tree.

Nothing is left out that could be in the result: a node is passed over only if its bound, widened by
the rounding of doubles, is *below* the kth score, so ties are found too. Scores are whole numbers
and exact. Where the data give the bounds nothing to hold on to (vectors spread evenly in many
dimensions) all leaves are visited, as blocks of matrix products: the work is then that of
comparing the stated queries with all rows in blocks.

Edge cases: a null vector, or one with a null or non-finite component, takes no part; components
beyond 2**53 after scaling count as non-finite. Vectors of other lengths are filled up with zeros.
A row with a null id is a candidate (last among ties) and never a query by its id. Rows that repeat
an id are rows of their own: each may ask, and each is found, but a row never finds itself. Fewer
candidates than k give fewer rows; an empty table, or one without queries, gives none. Scores beyond
a long are held at its ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votecount.llm.common import fresh_long, saved, shared_folder
from votecount.llm.vectors import floors, matrix, product

#: Points of a leaf; rows of a shard and queries of a block at most (fewer in small tables, so that
#: those have some tasks too); cells and sampled rows of the top of the tree; trees of one group.
LEAF, ROWS, BLOCK, CELLS, SAMPLE, TOGETHER = 64, 8192, 2048, 1024, 4096, 8
_LAST, _NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_FOUND = "q bigint, query_id bigint, c bigint, vec_id bigint, score bigint"
_TREE = "shard int, center array<double>, radius double, dims int, nodes binary, centers binary, radii binary, rows binary, points binary"


@dataclass
class Tree:
    """Node i holds points first[i] to last[i]; its children are at left[i] and left[i] + 1, or -1."""

    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    order: np.ndarray


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve every ball across the line between two far points until a leaf's number, or one place, is left."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    first, last, left, centers, radii = [0], [len(points)], [-1], [], []
    i = 0
    while i < len(first):
        a, b = first[i], last[i]
        own = points[order[a:b]]
        center = own.mean(axis=0)
        far = np.sqrt(((own - center) ** 2).sum(axis=1))
        centers.append(center)
        radii.append(far.max())
        if b - a > leaf and radii[-1] > 1e-9:
            pole = own[far.argmax()]
            other = own[((own - pole) ** 2).sum(axis=1).argmax()]
            middle = a + (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - pole), middle - a)]
            left[i] = len(first)
            first += [a, middle]
            last += [middle, b]
            left += [-1, -1]
        i += 1
    return Tree(*(np.array(x) for x in (first, last, left, centers, radii)), order)


def leaves_in_order(tree: Tree) -> list[int]:
    """Leaves from left to right: neighbours in the list are mostly near in space."""
    return sorted(np.flatnonzero(tree.left < 0).tolist(), key=lambda i: int(tree.first[i]))


def deal(counts: list[int], size: int) -> list[tuple[int, int]]:
    """(first bin, number of bins) of every cell, so that a bin gets about ``size`` rows at most."""
    out, bin_, room = [], 0, size
    for n in counts:
        if n > size:
            bin_ += room < size  # a bin that others have begun is left to them
            many = -(-n // size)
            out.append((bin_, many))
            bin_, room = bin_ + many, size
        else:
            if n > room:
                bin_, room = bin_ + 1, size
            out.append((bin_, 1))
            room -= n
    return out


class Best:
    """The k best candidates of every query so far, by score and then by id; ``_NONE`` where none is."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor = floor  # kth score known from elsewhere
        self.scores = np.full((len(floor), k), _NONE)
        self.ids = np.full((len(floor), k), _LAST)
        self.rows = np.full((len(floor), k), -1)

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[at], self.scores[at, -1])

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of a leaf for queries ``at``."""
        some = ((scores >= self.kth(at)[:, None]) & (scores > _NONE)).any(axis=1)
        at, scores = at[some], scores[some]
        if not len(at):
            return
        k = self.scores.shape[1]
        new = np.hstack([self.scores[at], scores])
        id_ = np.hstack([self.ids[at], np.broadcast_to(ids, scores.shape)])
        row = np.hstack([self.rows[at], np.broadcast_to(rows, scores.shape)])
        top = np.lexsort((row, id_, ~new), axis=-1)[:, :k]
        for mine, theirs in ((self.scores, new), (self.ids, id_), (self.rows, row)):
            mine[at] = np.take_along_axis(theirs, top, axis=1)


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, asks: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Branch and bound over one tree for a block of queries; ``points``, ``ids``, ``rows`` in tree order.

    The node with the largest bound over the queries that still need it comes first. ``asks`` are
    the queries' vectors and ``own`` their rows, which are no candidates for themselves.
    """
    wide = asks.astype(np.float64)
    length = np.sqrt((wide**2).sum(axis=1))

    def bounds(node: int, at: np.ndarray) -> np.ndarray:
        reach = length[at] * (np.sqrt((tree.centers[node] ** 2).sum()) + tree.radii[node])
        return wide[at] @ tree.centers[node] + length[at] * tree.radii[node] + 1e-9 * reach + 1e-6

    open_: list[tuple[float, int, np.ndarray, np.ndarray]] = []

    def push(node: int, at: np.ndarray) -> None:
        bound = bounds(node, at)
        need = bound >= best.kth(at)
        if need.any():
            heapq.heappush(open_, (-float(bound[need].max()), node, at[need], bound[need]))

    push(0, np.arange(len(asks)))
    while open_:
        _, node, at, bound = heapq.heappop(open_)
        at = at[bound >= best.kth(at)]
        if not len(at):
            continue
        if (child := int(tree.left[node])) >= 0:
            push(child, at)
            push(child + 1, at)
            continue
        # A leaf may be large if all its points are one: then the smallest ids are enough.
        for a in range(int(tree.first[node]), int(tree.last[node]), 1024):
            b = min(a + 1024, int(tree.last[node]))
            scores = np.clip(product(asks[at], points[a:b].T), _NONE + 1, _LAST).astype(np.int64)
            scores[own[at][:, None] == rows[a:b][None, :]] = _NONE
            best.offer(at, scores, ids[a:b], rows[a:b])


def _pack(tree: Tree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, null: np.ndarray) -> dict[str, bytes]:
    small = np.abs(points).max(initial=0) < 1 << 31
    meta = np.stack([ids, rows, null.astype(np.int64)])
    return {
        "nodes": np.stack([tree.first, tree.last, tree.left]).astype(np.int32).tobytes(),
        "centers": tree.centers.tobytes(),
        "radii": tree.radii.tobytes(),
        "rows": meta.tobytes(),
        "points": (b"4" if small else b"8") + points.astype(np.int32 if small else np.int64).tobytes(),
    }


def _unpack(row: dict) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dims = row["dims"]
    first, last, left = np.frombuffer(row["nodes"], np.int32).reshape(3, -1)
    centers = np.frombuffer(row["centers"], np.float64).reshape(-1, dims)
    tree = Tree(first, last, left, centers, np.frombuffer(row["radii"], np.float64), np.zeros(0))
    ids, rows, null = np.frombuffer(row["rows"], np.int64).reshape(3, -1)
    kind = np.int32 if row["points"][:1] == b"4" else np.int64
    points = np.frombuffer(row["points"][1:], kind).reshape(-1, dims).astype(np.int64)
    return tree, points, ids, rows, null.astype(bool)


def top_k(rows: DataFrame, asks: Column, k: int = 5, scale: int = 256, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for every row where ``asks`` holds."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    plain = rows.select(
        F.col(id_).cast("bigint").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), floors(F.col(vector), scale).alias("v")
    ).where(F.col("v").isNotNull())
    n, asking, dims = plain.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    if not asking or n < 2:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = max(1, dims)
    per_shard, per_block = min(ROWS, max(256, n // 32)), min(BLOCK, max(64, asking // 8))

    sample = min(SAMPLE, max(64, (1 << 24) // dims))
    few = plain.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(sample).toArrow()
    few = matrix(few.column("v"), dims)
    cells = min(CELLS, -(-n // per_shard))
    top = ball_tree(few, max(1, len(few) // cells))
    centers = top.centers[leaves_in_order(top)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centers**2).sum(axis=1) / 2
        for batch in batches:
            x = matrix(batch.column("v"), dims).astype(np.float64)
            cell = (x @ centers.T - half).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    # Numbered once and kept: the number tells a row from its copies.
    numbered = plain.withColumn("r", F.monotonically_increasing_id())
    placed = saved(numbered.mapInArrow(place, "vec_id bigint, asks boolean, v array<bigint>, r bigint, cell int"), f"{folder}/placed")
    held = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}
    shard_of = deal([held[c].n if c in held else 0 for c in range(len(centers))], per_shard)
    block_of = deal([held[c].q if c in held else 0 for c in range(len(centers))], per_block)
    bins = spark.createDataFrame(
        [(c, *shard_of[c], *block_of[c]) for c in range(len(centers))], "cell int, s int, s_many int, b int, b_many int"
    )
    dealt = placed.join(F.broadcast(bins), "cell")  # one row per cell, CELLS at most
    dealt = dealt.withColumn("shard", F.col("s") + F.pmod(F.xxhash64("r"), "s_many").cast("int"))
    dealt = dealt.withColumn("block", F.col("b") + F.pmod(F.xxhash64("r"), "b_many").cast("int"))

    def build(own: pa.Table) -> pa.Table:
        points = matrix(own.column("v"), dims)
        ids, r = own.column("vec_id"), own.column("r").to_numpy()
        null = ids.is_null().to_numpy()
        ids = ids.fill_null(_LAST).to_numpy()
        by_id = np.lexsort((r, ids))  # so that equal points of a leaf come in the order of their ids
        tree = ball_tree(points[by_id])
        at = by_id[tree.order]
        packed = _pack(tree, points[at], ids[at], r[at], null[at])
        head = {"shard": own.column("shard")[0].as_py(), "center": tree.centers[0].tolist(), "radius": float(tree.radii[0]), "dims": dims}
        return pa.Table.from_pylist([head | packed], _SHARD)

    def ball(own: pa.Table) -> pa.Table:
        x = matrix(own.column("v"), dims).astype(np.float64)
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max())
        return pa.Table.from_pylist([{"block": own.column("block")[0].as_py(), "b_center": center.tolist(), "b_radius": radius}], _BALL)

    trees = saved(dealt.select("shard", "vec_id", "r", "v").groupBy("shard").applyInArrow(build, _TREE), f"{folder}/trees")
    queries = saved(dealt.where("asks").select("block", F.col("r").alias("q"), F.col("vec_id").alias("query_id"), "v"), f"{folder}/queries")
    blocks = queries.select("block", "v").groupBy("block").applyInArrow(ball, "block int, b_center array<double>, b_radius double")
    blocks = saved(blocks, f"{folder}/blocks")

    # What two balls allow at most; one row of metadata per block of queries and shard.
    last_block = max(b + many for b, many in block_of) - 1
    shards = max(s + many for s, many in shard_of)
    met = trees.select("shard", "center", "radius", F.explode(F.sequence(F.lit(0), F.lit(last_block))).alias("block")).join(blocks, "block")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    bound = dot("center", "b_center") + norm(F.col("b_center")) * F.col("radius") + F.col("b_radius") * (norm(F.col("center")) + F.col("radius"))
    reach = (norm(F.col("center")) + F.col("radius")) * (norm(F.col("b_center")) + F.col("b_radius"))
    met = met.select("block", "shard", (bound + reach * 1e-9 + 1e-6).alias("bound"))
    in_turn = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
    pairs = saved(met.withColumn("turn", F.row_number().over(in_turn) - 1), f"{folder}/pairs")

    def group(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return _HITS.empty_table()
        vectors, own = matrix(asked.column("v"), dims), asked.column("q").to_numpy()
        floor = asked.column("floor").fill_null(_NONE).to_numpy()
        best, null_ids = Best(floor, k), []
        for row in sorted(found.to_pylist(), key=lambda r: (-r["bound"], r["shard"])):
            tree, points, ids, r, null = _unpack(row)
            search(tree, points, ids, r, vectors, own, best)
            null_ids.append(r[null])
        at, place_ = np.nonzero(best.scores > _NONE)
        r = best.rows[at, place_]
        ids = pa.array(best.ids[at, place_], mask=np.isin(r, np.concatenate(null_ids)))
        asker = asked.column("query_id").combine_chunks().take(pa.array(at))
        return pa.table([pa.array(own[at]), asker, pa.array(r), ids, pa.array(best.scores[at, place_])], schema=_HITS)

    best = None
    turn, width, step = 0, 1, 0
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c")
    while turn < shards:
        now = pairs.where((F.col("turn") >= turn) & (F.col("turn") < turn + width))
        now = now.withColumn("together", F.floor((F.col("turn") - turn) / TOGETHER).cast("int"))
        asked = queries.withColumn("floor", F.lit(None).cast("bigint"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("score").alias("_s"))
            asked = queries.join(kth, F.col("q") == F.col("_q"), "left").withColumn("floor", F.col("_s")).drop("_q", "_s")
            low = asked.groupBy("block").agg(F.when(F.count("floor") == F.count(F.lit(1)), F.min("floor")).alias("low"))
            now = now.join(low, "block").where(F.col("low").isNull() | (F.col("bound") >= F.col("low"))).drop("low")
        sides = now.select(F.col("block").alias("b"), F.col("together").alias("t")).distinct()
        left = asked.withColumnRenamed("block", "b").join(sides, "b")
        right = now.join(trees.drop("center", "radius"), "shard")
        hits = left.groupBy("b", "t").cogroup(right.groupBy("block", "together")).applyInArrow(group, _FOUND)
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = saved(best, f"{folder}/best-{step}")
        turn, width, step = turn + width, width * 8, step + 1
    return best.select("query_id", "rank", "vec_id", "score")


_SHARD = pa.schema(
    [("shard", pa.int32()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("dims", pa.int32())]
    + [(c, pa.binary()) for c in ("nodes", "centers", "radii", "rows", "points")]
)
_BALL = pa.schema([("block", pa.int32()), ("b_center", pa.list_(pa.float64())), ("b_radius", pa.float64())])
_HITS = pa.schema([(c, pa.int64()) for c in ("q", "query_id", "c", "vec_id", "score")])

#: Plain SQL for the rows of ``top_k``: every query against every row.
SQL = """
WITH rows_ AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows_ q JOIN rows_ c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
