"""Group facts and first-wins under hot keys; greedy storing of files against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from votecount.operators import groups
from votecount.operators import machine as m

T0 = datetime(2025, 8, 17)


def skewed(spark, n=400, seed=1):
    rnd = random.Random(seed)
    keys = [None, "hot", "hot", "warm"] + [f"k{i}" for i in range(30)]
    rows = [(i, rnd.choice(keys), rnd.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, key string, v long")


def test_attach_equals_a_window(spark):
    rows, df = skewed(spark)
    got = groups.attach(df, "key", {"total": F.sum("v"), "primero": F.min("seq")}, "seq", among=F.col("v") > 2)
    found = {r.seq: (r.total, r.primero) for r in got.collect()}
    for seq, key, v in rows:
        members = [(s, x) for s, k, x in rows if k == key and x > 2]
        wanted = (sum(x for _, x in members), min(s for s, _ in members)) if key and v > 2 else (None, None)
        assert found[seq] == wanted
    assert len(found) == len(rows)


def test_attach_leaves_out_small_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, key string")
    got = groups.attach(df, "key", {"primero": F.min("seq")}, "seq", min_rows=2)
    assert {r.seq: r.primero for r in got.collect()} == {1: 1, 2: 1, 3: None}


def test_a_hot_key_is_split_at_run_time(spark):
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
        df = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("seq"), key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        got = groups.attach(df, "key", {"n": F.count(F.lit(1))}, "seq")
        assert got.where("n > 60000").count() == 66_667
        taken = got.select("seq", "n", "text")
        taken.collect()
        assert "skew=true" in taken._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stamp_orders_and_decodes(spark):
    rows = [(T0, 10**18 - 1, True), (T0, 0, False), (datetime(1960, 1, 1), 7, True)]
    df = spark.createDataFrame(rows, "t timestamp, seq long, b boolean").withColumn(
        "s", groups.stamp(F.col("t"), F.col("seq"), F.col("b")))
    got = df.orderBy("s").select(groups.stamp_seq(F.col("s")).alias("q"), groups.stamp_bit(F.col("s")).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(7, True), (0, False), (10**18 - 1, True)]


def test_first_wins(spark):
    df = spark.createDataFrame(
        [("a", 2, T0), ("a", 1, T0), ("b", 3, T0 + timedelta(hours=1)), ("b", 4, T0)],
        "key string, seq long, t timestamp")
    kept = groups.first_wins(df, "key", groups.stamp(F.col("t"), F.col("seq"))).collect()
    assert {r.key: r.seq for r in kept} == {"a": 1, "b": 4}


def test_first_wins_without_a_time_or_an_order(spark):
    df = spark.createDataFrame(
        [("a", 2, None), ("a", 1, T0), ("b", 3, None), ("b", 4, None), (None, 5, None)], "key string, seq long, t timestamp")
    kept = groups.first_wins(df, "key", groups.stamp(F.col("t"), F.col("seq"))).collect()
    assert {r.key: r.seq for r in kept} == {"a": 1, "b": 3, None: 5}
    bare = groups.first_wins(df, "key", F.when(F.col("t").isNotNull(), F.col("seq"))).collect()
    assert sorted(r.key or "" for r in bare) == ["", "a", "b"] and {r.seq for r in bare if r.key == "a"} == {1}


def brute_force(rows):
    """rows in arrival order: (seq, hash, id) -> result and blocking seq."""
    hashes, ids, out = {}, {}, {}
    for seq, h, i in rows:
        if h in hashes:
            out[seq] = (m.SAME_FILE, hashes[h])
        elif i in ids:
            out[seq] = (m.SAME_SHEET, ids[i])
        else:
            hashes[h], ids[i] = seq, seq
            out[seq] = (m.STORED, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_files_with_chains(spark, seed):
    rnd = random.Random(seed)
    rows = [(n, f"h{rnd.randint(0, 25)}", f"MESA-{rnd.randint(0, 25)}") for n in range(80)]
    df = spark.createDataFrame(
        [(s, T0 + timedelta(seconds=s), h, i) for s, h, i in rows],
        "seq long, fecha_recepcion timestamp, hash_origen string, acta_id string")
    got = {r.seq: (r.resultado, r.previo) for r in m.greedy_first(df).collect()}
    assert got == brute_force(rows)


def test_sheets_without_a_hash_are_all_stored(spark):
    rows = [(1, "A", "h1"), (2, "B", None), (3, "C", None), (4, "D", "h4"), (5, "B", None), (6, "E", "h1")]
    sheets = spark.createDataFrame(rows, "seq long, acta_id string, hash_origen string").withColumn(
        "fecha_recepcion", F.timestamp_seconds(F.col("seq")))
    assert sorted(r.seq for r in m.storable_sheets(sheets).collect()) == [1, 2, 3, 4]
    stored = spark.createDataFrame([("D", None), ("Z", "h1")], "acta_id string, hash_origen string")
    assert sorted(r.seq for r in m.storable_sheets(sheets, stored).collect()) == [2, 3]
