"""Connected components of a table of links, by rounds of contraction on Spark.

In a round every node moves to the neighbour (or itself) with the smallest random rank, and the
links move along; links within a place vanish. A round shrinks a path by two fifths on average and a
star to one node, so the rounds are few whatever the order of the ids. Each is written to the shared
folder before the next reads it, which bounds the lineage: a lost executor repeats one round at most.
A hub is reduced by the map-side combine and its links are split by the run-time skew join; nothing
is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import discard, fresh_long, saved


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node reachable. ``links`` has bigint columns a and b.

    Nodes without a link to another are left out; null ends and self links are ignored.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = saved(ordered.distinct(), f"{folder}/links-0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(moves)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("r"), c.alias("to"))
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        move = best.select(F.col("a").alias("node"), F.least("m", rank(F.col("a")))["to"].alias("to"))
        move = saved(move, f"{folder}/moves-{k}")
        moves.append(move)
        at_a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        at_b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("x <> y")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = saved(moved, f"{folder}/links-{k + 1}")
        discard(edges.sparkSession, f"{folder}/links-{k}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[0].withColumnRenamed("to", "at")
    for move in moves[1:]:
        further = move.select(F.col("node").alias("at"), F.col("to"))
        found = found.join(further, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    found = saved(found, f"{folder}/places")
    discard(found.sparkSession, *[f"{folder}/moves-{k}" for k in range(len(moves))])
    # The place is some node of the component; its smallest one is its name.
    names = found.groupBy("at").agg(F.min(F.least("node", "at")).alias("component"))
    names = names.select(fresh_long(F.col("at")).alias("key"), "component")
    return saved(
        found.withColumn("key", fresh_long(F.col("at"))).join(names, "key").select("node", "component"),
        f"{folder}/components",
    )
