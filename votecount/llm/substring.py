"""Passages that repeat across documents: near copies of paragraphs, then shared runs of words.

A paragraph is a line of at least ``MIN_WORDS`` words, the set of its distinct five-word shingles.
Equal sets are one class. Bands are tuned for high recall, colliding paragraphs meet as stars, and
links are decided on the exact Jaccard similarity of the full sets (0.8). Of every component of
links the first occurrence (smallest document id, then line) stays and all others are removed.
Of what is left, every run of 50 words or more that occurs before (smallest document id, then place)
is removed in its full span, across line breaks and within lines (``passages``).

Edge cases: null and empty texts come back as they are; shorter lines are removed only as parts of a
longer shared run, so stock phrases and headings stay; what stood on both sides of a removed run is
not compared again as one; identical rows (same id, same text) are one occurrence, and a passage
repeated within a document goes too; rows without an id count as last, told apart by their text;
ties fall to the smaller line; a text may end up empty; an empty table gives an empty result. Other
columns pass through whatever their names. Very long texts are hashed in parts; the removals of one
document are bounded by its own lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.llm import passages
from votecount.llm.common import discard, fresh_long, saved, shared_folder
from votecount.llm.components import components
from votecount.llm.setlinks import band_keys, exact_links, minima, stars, tune, with_blocks
from votecount.llm.tokens import slices_by_bytes
from votecount.llm.words import BETWEEN_SPACES, shingle_sets, words_of

SHINGLE = 5
MIN_WORDS = 30
PCT = 80
HASHES, RECALL = 64, 0.999


def _document_key(key: str, text: str) -> dict[str, Column]:
    """Two hashes that tell rows apart by id and text."""
    known = [F.col(key), F.col(text)]
    return {"__d1": F.xxhash64(*known), "__d2": F.xxhash64(F.lit("other"), *reversed(known))}


def _lines(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of the texts of a batch, the row each belongs to, and its place there."""
    split = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    owner = pc.list_parent_indices(split).to_numpy()
    lines = pc.list_flatten(split)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    return lines, owner, place


_ROW = "id bigint, d1 bigint, d2 bigint, line int, n bigint, k1 bigint, k2 bigint, bands array<bigint>"


def _paragraphs(bands: int, rows: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                lines, owner, place = _lines(batch)
                words = words_of(lines, BETWEEN_SPACES)
                long = np.flatnonzero(np.diff(words.first) >= MIN_WORDS)
                if not len(long):
                    continue
                sets = shingle_sets(words, SHINGLE, long)
                keys = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                rows_of = pa.array(owner[long])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(rows_of) for c in ("id", "d1", "d2")],
                        pa.array(place[long], pa.int32()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([band_keys(minima(s, HASHES), bands, rows) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "d1", "d2", "line", "n", "k1", "k2", "bands"],
                )

    return found


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the shingles of the lines asked for."""
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            asked = [(i, w) for i, ws in enumerate(batch.column("wanted").to_pylist()) for w in ws]
            lines, owner, _ = _lines(batch)
            first = np.searchsorted(owner, np.arange(batch.num_rows), "left")
            at = pa.array([int(first[i]) + w["line"] for i, w in asked], pa.int64())
            sets = shingle_sets(words_of(lines.take(at), BETWEEN_SPACES), SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["cluster"] for _, w in asked], pa.int64()),
                    pa.array([w["blocks"] for _, w in asked], pa.int32()),
                    pa.array([w["id"] for _, w in asked], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["cluster", "blocks", "id", "items"],
            )


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"),
        *[c.alias(n.strip("_")) for n, c in _document_key(key, text).items()],
    )


def _occurrences(plain: DataFrame, pct: int, folder: str) -> DataFrame:
    """Paragraphs that have a copy: root (the name of the group), id, d1, d2, line."""
    bands, rows = tune(pct / 100, RECALL, HASHES)
    # The number of a paragraph is drawn once, when the table is written.
    paragraphs = plain.mapInArrow(_paragraphs(bands, rows), _ROW).withColumn("p", F.monotonically_increasing_id())
    spark, banded = plain.sparkSession, saved(paragraphs, f"{folder}/banded")
    paragraphs = saved(banded.drop("bands"), f"{folder}/paragraphs")
    classes = banded.groupBy("k1", "k2", "n").agg(
        F.min("p").alias("id"), F.count(F.lit(1)).alias("times"), F.first("bands").alias("bands")
    )
    banded = saved(classes, f"{folder}/banded-classes")
    discard(spark, f"{folder}/banded")
    classes = saved(banded.drop("bands"), f"{folder}/classes")
    pairs = stars(banded.select("id", F.explode("bands").alias("band")), folder)
    coarse = components(pairs.select(F.col("rep").alias("a"), F.col("id").alias("b")), f"{folder}/coarse")
    discard(spark, f"{folder}/banded-classes", f"{folder}/buckets")
    members = coarse.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    members = saved(with_blocks(members.join(classes.select("id", "n"), "id")), f"{folder}/members")
    places = paragraphs.select(F.col("p").alias("id"), "d1", "d2", "line").join(members, "id")
    wanted = places.groupBy("d1", "d2").agg(
        F.collect_list(F.struct("line", "cluster", "blocks", "id")).alias("wanted")
    )
    texts = plain.select("d1", "d2", "text").join(wanted, ["d1", "d2"]).select("text", "wanted")
    sets = texts.mapInArrow(_wanted_sets, "cluster bigint, blocks int, id bigint, items binary")
    links = saved(exact_links(sets, pct), f"{folder}/links")
    found = components(links, f"{folder}/groups").withColumnRenamed("node", "id")
    named = classes.select("k1", "k2", "n", "id", "times").join(found, "id", "left")
    named = named.where("times > 1 or component is not null")
    named = named.select("k1", "k2", "n", F.coalesce("component", "id").alias("root"))
    met = paragraphs.select("id", "d1", "d2", "line", "k1", "k2", "n").join(named, ["k1", "k2", "n"])
    return saved(met.select("root", "id", "d1", "d2", "line"), f"{folder}/occurrences")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = PCT) -> DataFrame:
    """All columns of ``docs``, the text without repeats, and ``__removed``: lines, cut (lines), kept_in (ids)."""
    folder = f"{shared_folder(docs.sparkSession)}/substring"
    plain = _plain(docs, key, text)
    met = _occurrences(plain, pct, folder)
    place = F.struct(F.col("id").isNull().alias("no"), "id", "line", "d1", "d2")
    stays = met.groupBy("root").agg(F.min(place).alias("stays"))
    stays = stays.select(fresh_long(F.col("root")).alias("key"), "stays")
    gone = met.withColumn("key", fresh_long(F.col("root"))).join(stays, "key").where(place != F.col("stays"))
    gone = gone.groupBy("d1", "d2").agg(
        F.array_sort(F.collect_set("line")).alias("lines"), F.collect_set("stays.id").alias("kept_in")
    )
    gone = saved(gone, f"{folder}/gone")
    runs = passages.repeats(plain, gone, f"{folder}/passages").withColumnRenamed("kept_in", "also")
    none = F.array().cast
    all_ids = F.array_union(*[F.coalesce(c, none("array<bigint>")) for c in ("kept_in", "also")])
    gone = gone.join(runs, ["d1", "d2"], "full").select(
        F.col("d1").alias("__d1"), F.col("d2").alias("__d2"),
        F.struct(F.coalesce("lines", none("array<int>")).alias("lines"), "starts", F.array_sort(all_ids).alias("kept_in")).alias("__gone"),
    )
    gone = saved(gone, f"{folder}/all")
    discard(docs.sparkSession, *[f"{folder}/{t}" for t in ("paragraphs", "classes", "occurrences", "gone", "passages")])
    df = docs.withColumns(_document_key(key, text)).join(gone, ["__d1", "__d2"], "left")
    # Only texts with runs to cut go through Python.
    cut_runs = F.arrow_udf(passages.cut, passages.CUT)
    starts = F.col("__gone.starts")
    df = df.withColumn("__cut", cut_runs(F.when(starts.isNotNull(), F.col(text)), F.col("__gone.lines"), starts))
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone.lines"))
    without = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).when(starts.isNotNull(), F.col("__cut.text")).otherwise(without)
    removed = F.struct(
        F.coalesce("__cut.removed", "__gone.lines").alias("lines"),
        F.coalesce("__cut.cut", none("array<int>")).alias("cut"),
        F.col("__gone.kept_in").alias("kept_in"),
    )
    removed = F.when(F.col("__gone").isNotNull(), removed).alias("__removed")
    return df.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], removed)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = PCT) -> DataFrame:
    """Per document: key, text (without repeats), n_lines, n_removed, removed_lines, cut_lines, kept_in.

    Removed lines are gone whole; of cut lines a part is.
    """
    plain = docs.select(key, text).withColumn("__n", F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))
    found = remove_repeats(plain, key, text, pct)
    none = F.array().cast
    return found.select(
        key,
        text,
        F.col("__n").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__removed.lines"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("__removed.lines", none("array<int>")).alias("removed_lines"),
        F.coalesce("__removed.cut", none("array<int>")).alias("cut_lines"),
        F.coalesce("__removed.kept_in", none("array<bigint>")).alias("kept_in"),
    )


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", pct: int = PCT) -> DataFrame:
    """The documents in their own columns without repeats; those of which no word is left are gone."""
    found = remove_repeats(docs, key, text, pct)
    left = F.col("__removed").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return found.where(left).select(*[F.col(f"`{c}`") for c in docs.columns])
