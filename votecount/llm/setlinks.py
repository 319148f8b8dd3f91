"""MinHash candidates and exact links between sets of shingles.

Sets that share a band meet in a bucket, which gives one candidate pair for every member with the
bucket's smallest: a star, never all pairs. The components of the stars are coarse clusters that
hold every link between their members (similar sets share about a dozen buckets). Inside a cluster
all links are found exactly from the full sets: the counts of common shingles are products of
incidence matrices over the shingles that at least two members have. A large cluster is cut into
blocks of bounded size and each pair of blocks is a group of its own; a group returns a spanning
forest of its links, so that what leaves it is at most one row per member.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import fresh_long, saved
from votecount.llm.words import constants, mix

#: Size of a block: shingles in all, and members.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 19, 128
_STEP = 1 << 18


def tune(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that still give the recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no number of rows gives this recall")


@lru_cache
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of 32-bit hash functions."""
    a = constants(hashes, 11).astype(np.uint32) | np.uint32(1)
    return a, (constants(hashes, 12) >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The minimum of every hash function over a set that is not empty."""
    a, b = _functions(hashes)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    width = max(1, _STEP // hashes)
    for i in range(0, len(x), width):
        np.minimum(out, (x[None, i : i + width] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def band_keys(lows: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, as signed numbers; the band's number goes into the key."""
    part = lows[: bands * rows].reshape(bands, rows).astype(np.uint64) + np.uint64(1)
    return mix((part * constants(rows, 13)).sum(axis=1, dtype=np.uint64) + constants(bands, 14)).view(np.int64)


def stars(rows: DataFrame, folder: str) -> DataFrame:
    """Distinct (rep, id) of the rows (id, band): every member of a bucket with its smallest."""
    buckets = rows.groupBy("band").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    buckets = saved(buckets.select(fresh_long(F.col("band")).alias("key"), "rep"), f"{folder}/buckets")
    met = rows.select(fresh_long(F.col("band")).alias("key"), "id").join(buckets, "key")
    return met.where("id <> rep").select("rep", "id").distinct()


def with_blocks(members: DataFrame) -> DataFrame:
    """(id, cluster, n) and the number of blocks the cluster is cut into."""
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("m"))
    blocks = F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_MEMBERS), F.lit(1))
    sizes = sizes.select(fresh_long(F.col("cluster")).alias("key"), blocks.cast("int").alias("blocks"))
    return members.withColumn("key", fresh_long(F.col("cluster"))).join(sizes, "key").select("id", "cluster", "blocks")


def exact_links(sets: DataFrame, pct: int, hopeful: Callable[[list, int], np.ndarray] | None = None) -> DataFrame:
    """Links (a, b) of rows (cluster, blocks, id, items): 100 * common >= pct * union, as a forest.

    ``items`` holds a set's shingles as 64-bit numbers, sorted, little-endian. ``hopeful`` tells from
    a further column ``bits`` which pairs of a group need the comparison of their sets.
    """
    more = ["bits"] if hopeful else []
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # Of several blocks every pair of two is a group, which takes in the pairs inside both.
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != own)
    )
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "items", *more
    )

    def linked(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), np.int64)
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        a, b = forest(ids, items, pct, hopeful(group.column("bits").to_pylist(), pct) if hopeful else None)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(linked, "a bigint, b bigint")


def common_counts(items: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets have in common."""
    m = len(items)
    owner = np.repeat(np.arange(m), [len(x) for x in items])
    _, column, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m))
    n = int(column[-1]) + 1 if len(column) else 0
    width = min(n, max(1024, (1 << 22) // m))
    for first in range(0, n, width or 1):
        low, high = np.searchsorted(column, [first, first + width])
        matrix = np.zeros((m, width), np.float32)
        matrix[owner[low:high], column[low:high] - first] = 1
        total += matrix @ matrix.T
    return total


def forest(
    ids: np.ndarray, items: list[np.ndarray], pct: int, hopeful: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Each member that is linked with the smallest one it can reach within the group."""
    if len(ids) < 2:
        return [], []
    order = np.argsort(ids, kind="stable")
    ids, items = ids[order], [items[i] for i in order]
    size = np.array([len(x) for x in items], float)
    linked = np.zeros((len(ids), len(ids)), bool)
    # Members without a hopeful pair between them, by however many steps, are never compared.
    parts = [np.arange(len(ids))]
    if hopeful is not None:
        hopeful = hopeful[np.ix_(order, order)]
        root = reached(hopeful)
        parts = [np.flatnonzero(root == r) for r in np.unique(root)]
    for part in parts:
        if len(part) > 1:
            common = common_counts([items[i] for i in part])
            own = size[part]
            linked[np.ix_(part, part)] = 100 * common >= pct * (own[:, None] + own[None, :] - common)
    if hopeful is not None:
        linked &= hopeful
    linked &= (size > 0)[:, None] & (size > 0)[None, :]
    root = reached(linked)
    moved = np.flatnonzero(ids != ids[root])
    return ids[moved].tolist(), ids[root[moved]].tolist()


def reached(linked: np.ndarray) -> np.ndarray:
    """The first member that each can be reached from, through a symmetric matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while front.size:
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    return root
