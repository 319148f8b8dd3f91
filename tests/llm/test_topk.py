import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, odd_columns
from votecount.llm import topk

EMB = "vec_id long, embedding array<float>, label int"


def told_plainly(rows, asks, k=5, scale=256):
    """Every asking row against every other one."""
    whole = []
    for i, (id_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, id_, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    for i, id_, v in whole:
        if id_ is None or not asks(id_):
            continue
        scored = []
        for j, other, w in whole:
            if i != j:
                score = sum(a * b for a, b in zip(v, w))
                scored.append((-score, other is None, other if other is not None else 0, j))
        for rank, (score, null, other, _) in enumerate(sorted(scored)[:k], 1):
            out.append((id_, rank, None if null else other, -score))
    return sorted(out, key=repr)


def found(spark, rows, n=2, **names):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    df = odd_columns(df, "q", "r", "v", "c", "cell", "shard", "block", "floor", "rank", "a.b")
    got = topk.top_k(df, F.col("vec_id") % n == 0, **names)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_awkward_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)]) for i in range(40)]
    same = [0.5, 0.25, -0.125, 0.0, 0.0, 1.0]
    rows += [(100 + i, same) for i in range(12)] + [(7, same), (8, same), (8, same), (None, same)]
    rows += [(200, None), (202, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (204, [float("nan")] + [0.0] * 5)]
    rows += [(206, [float("inf")] + [0.0] * 5), (208, []), (210, [1.0, -1.0]), (212, [0.0] * 6)]
    assert found(spark, rows) == told_plainly(rows, lambda i: i % 2 == 0)


@pytest.mark.parametrize("rows", [[], [(2, [1.0])], [(1, [1.0]), (3, [1.0])], [(2, None), (4, None)]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == []


def test_fewer_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0])]
    assert found(spark, rows) == told_plainly(rows, lambda i: i % 2 == 0)


def test_scores_beyond_doubles(spark):
    """Products that a double would round are told apart; those beyond a long are held at its end."""
    odd, half = float(2**30), float(2**7)
    rows = [(0, [odd, 1.0]), (1, [odd, 0.0]), (2, [odd, 1.0]), (3, [odd, half]), (4, [-odd, 0.0])]
    assert found(spark, rows, scale=1) == told_plainly(rows, lambda i: i % 2 == 0, scale=1)
    far = [(0, [float(2**40)]), (1, [float(2**41)]), (2, [-float(2**40)])]
    assert found(spark, far, scale=1) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63), (2, 1, 0, 1 - 2**63), (2, 2, 1, 1 - 2**63)]


def test_many_shards_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 300)
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(9, 8))
    rows = [(i, (centers[i % 9] + rng.normal(scale=0.1, size=8)).tolist()) for i in range(4000)]
    rows += [(4000 + i, centers[0].tolist()) for i in range(2000)]  # a third of all rows
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    m = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    wanted = []
    for i in range(0, 6000, 50):
        s = m @ m[i]
        order = [j for j in np.lexsort((np.arange(6000), -s)) if j != i][:5]
        wanted += [(i, rank, int(j), int(s[j])) for rank, j in enumerate(order, 1)]
    assert got == sorted(wanted)


def test_near_clusters_are_passed_over():
    """With vectors in clusters most leaves are never opened."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16)) * 100
    points = np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 16))
    points = np.floor(points).astype(np.int64)
    tree = topk.ball_tree(points)
    points = points[tree.order]
    seen = []
    best = topk.Best(np.full(1, topk._NONE), 5)
    offer = best.offer
    best.offer = lambda at, scores, ids, rows: (seen.append(len(ids)), offer(at, scores, ids, rows))
    topk.search(tree, points, tree.order, tree.order, points[:1], tree.order[:1], best)
    s = points @ points[0]
    s[0] = -(10**9)
    assert sorted(best.scores[0].tolist(), reverse=True) == sorted(s.tolist(), reverse=True)[:5]
    assert sum(seen) < 600


def test_deal_keeps_bins_small():
    rnd = random.Random(2)
    counts = [rnd.choice([0, 1, 5, 40, 99, 100, 101, 950]) for _ in range(60)]
    bins = {}
    for n, (first, many) in zip(counts, topk.deal(counts, 100)):
        for b in range(first, first + many):
            bins[b] = bins.get(b, 0) + n / many
    assert all(total <= 100 for total in bins.values())
    assert sorted(bins) == list(range(max(bins) + 1))


def test_agrees_with_sql(spark):
    got = topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    wanted = con.execute(f"select query_id, rank, vec_id, score from ({topk.SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)
