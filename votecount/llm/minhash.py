"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct five-word shingles. Equal sets are one class, which takes part
once. Of every class the minima of 192 hash functions are banded (tuned so that a pair at the
threshold is missed once in a million). Candidates come from the bands as stars, all of which count:
a star's centre may be unlike two members that are near copies of each other. What is linked is
decided inside the clusters that the stars make up: every pair of a block is estimated from two low
bits of each minimum, packed into six longs and compared by bit counts with the collisions of chance
taken off; pairs that are not hopeless are compared on the full sets (``setlinks.exact_links``).
Components of the links are the groups.

Edge cases: a text with fewer than five words is one shingle, its whole sequence; a null text or one
without words has an empty set and is linked with nothing; equal texts are one group, named by their
smallest id. Rows are numbered inside, so that rows that repeat an id, or have none, are rows like
others: each is in its group, ``groups`` marks all rows that bear the group's name, and ``keep_one``
leaves one row of each group (all rows without words). A group in which no row has an id has no name.
Very long texts are hashed in parts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import saved, shared_folder
from votecount.llm.components import components
from votecount.llm.setlinks import band_keys, exact_links, minima, stars, tune, with_blocks
from votecount.llm.tokens import slices_by_bytes
from votecount.llm.words import BETWEEN_SPACES, shingle_sets, words_of

SHINGLE = 5
PCT = 85
HASHES, RECALL = 192, 0.999999
BITS = 2
#: How far an estimate may lie below the threshold before the pair is passed over.
SLACK = 0.35
_SIGNED = np.int64


def packed(lows: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed into signed longs."""
    per = 64 // bits
    low = (lows & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1).view(_SIGNED)


def estimates(bits: np.ndarray) -> np.ndarray:
    """Similarity of every two packed signatures (rows of longs) by bit counts, corrected for chance.

    Two bits of a minimum agree if neither differs; unlike minima agree by chance once in four.
    """
    lanes = np.uint64(0x5555555555555555)
    low = bits.view(np.uint64)
    differs = np.zeros((len(low), len(low)), np.int64)
    for lane in low.T:
        x = lane[:, None] ^ lane[None, :]
        differs += np.bitwise_count((x | (x >> np.uint64(1))) & lanes)
    chance = 2.0**-BITS
    return (1 - differs / HASHES - chance) / (1 - chance)


def hopeful(bits: list, pct: int) -> np.ndarray:
    """Which pairs are worth an exact comparison: a pair at the threshold falls short of this bound by
    some ten standard errors of its estimate (0.03), and each pair is judged by itself alone."""
    return estimates(np.array(bits, _SIGNED)) >= pct / 100 - SLACK


_ROW = "p bigint, id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, bits array<bigint>"


def _signatures(bands: int, rows: int):
    """Of each document the size, name, bands and packed bits of its set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                sets = shingle_sets(words_of(batch.column("text"), BETWEEN_SPACES), SHINGLE)
                keys = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), _SIGNED) for s in sets]
                lows = [minima(s, HASHES) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("p"),
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([None if x is None else band_keys(x, bands, rows) for x in lows], pa.list_(pa.int64())),
                        pa.array([None if x is None else packed(x) for x in lows], pa.list_(pa.int64())),
                    ],
                    ["p", "id", "n", "k1", "k2", "bands", "bits"],
                )

    return signed


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            sets = shingle_sets(words_of(batch.column("text"), BETWEEN_SPACES), SHINGLE)
            items = pa.array([s.tobytes() for s in sets], pa.binary())
            kept = ["cluster", "blocks", "id", "bits"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], items], [*kept, "items"])


def _grouped(docs: DataFrame, key: str, text: str, pct: int) -> tuple[DataFrame, DataFrame]:
    """The rows (p, their number; rest, their columns but the text; text) and, per p: id, n, component, name."""
    folder = shared_folder(docs.sparkSession)
    bands, rows = tune(pct / 100, RECALL, HASHES)
    named = lambda c: F.col(f"`{c}`")
    rest = F.struct(named(key).alias("c0"), *[named(c).alias(f"c{i}") for i, c in enumerate(_rest(docs, key, text), 1)])
    plain = docs.select(named(key).cast("bigint").alias("id"), named(text).alias("text"), rest.alias("rest"))
    # The number of a row is drawn once, when the table is written; ids may be missing or repeated.
    # Texts do not go through Python on their way there, which keeps the memory of its workers low.
    numbered = saved(plain.withColumn("p", F.monotonically_increasing_id()), f"{folder}/numbered", "gzip")
    signed = saved(numbered.select("p", "id", "text").mapInArrow(_signatures(bands, rows), _ROW), f"{folder}/signed")
    classes = saved(
        signed.where("n > 0")
        .groupBy("k1", "k2", "n")
        .agg(F.min("p").alias("id"), F.min("id").alias("least"), F.first("bands").alias("bands")),
        f"{folder}/classes",
    )
    pairs = stars(classes.select("id", F.explode("bands").alias("band")), folder)
    # No spoke is dropped by an estimate: two near copies may meet only through a third, unlike document.
    coarse = components(pairs.select(F.col("rep").alias("a"), F.col("id").alias("b")), f"{folder}/coarse")
    members = coarse.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    members = saved(with_blocks(members.join(classes.select("id", "n"), "id")), f"{folder}/members")
    # One row per class, however many copies it has.
    members = members.join(signed.select(F.col("p").alias("id"), "bits"), "id")
    texts = numbered.select(F.col("p").alias("id"), "text").join(members, "id").select("cluster", "blocks", "id", "bits", "text")
    sets = texts.mapInArrow(_sets, "cluster bigint, blocks int, id bigint, bits array<bigint>, items binary")
    links = saved(exact_links(sets, pct, hopeful), f"{folder}/links")
    found = components(links, f"{folder}/groups").withColumnRenamed("node", "id")
    placed = classes.select("k1", "k2", "n", "id", "least").join(found, "id", "left")
    placed = saved(placed.withColumn("component", F.coalesce("component", "id")), f"{folder}/placed")
    names = placed.groupBy("component").agg(F.min("least").alias("name"))
    placed = placed.join(names, "component").select("k1", "k2", "n", "component", "name")
    answer = signed.select("p", "id", "n", "k1", "k2").join(placed, ["k1", "k2", "n"], "left")
    # Rows with an empty set are alone.
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))
    return numbered.select("p", "rest", "text"), answer.select("p", "id", "n", "component", name.alias("name"))


def _rest(docs: DataFrame, key: str, text: str) -> list[str]:
    return [c for c in docs.columns if c not in (key, text)]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = PCT) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest id of its group), kept."""
    _, found = _grouped(docs.select(f"`{key}`", f"`{text}`"), key, text, pct)
    return found.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"),
        F.col("id").eqNullSafe(F.col("name")).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = PCT) -> DataFrame:
    """One document of each group, in its own columns: of those with the smallest id the first row."""
    rows, found = _grouped(docs, key, text, pct)
    sets = found.where("n > 0")
    stay = sets.where(F.col("id").eqNullSafe(F.col("name"))).groupBy("component").agg(F.min("p").alias("p"))
    dropped = sets.select("p").join(stay.select("p"), "p", "left_anti")
    left = rows.join(dropped, "p", "left_anti")
    places = {key: "c0", **{c: f"c{i}" for i, c in enumerate(_rest(docs, key, text), 1)}}
    return left.select(*[(F.col("text") if c == text else F.col(f"rest.{places[c]}")).alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM s
), e AS (
  SELECT doc_id, unnest(g) AS g FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT x, y FROM link
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), m AS (
  SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
  doc_id <= coalesce(least, doc_id) AS kept
FROM n LEFT JOIN m USING (doc_id)
"""
