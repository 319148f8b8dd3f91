"""Runs of words that repeat across documents, wherever their lines begin and end.

A window is ``RUN`` words in a row. Of its grams of ``GRAM`` words the smallest hash is its anchor,
which depends on the window alone, so equal windows have equal anchors. Only anchors that are met at
two places or more are looked at: all windows around one place of an anchor are one row, a run of at
most ``RUN - GRAM + 1`` windows. Within a passage such runs are equal as a whole and settle in one row;
only where an anchor has several different runs, which is at the ends of passages, their distinct ones
are opened into single windows. Every window that has an equal one before it is a repeat, and all words
that a repeat covers are gone, which is the full span of every shared run of ``RUN`` words or more,
however long. Nothing is drawn by chance and nothing missed.

A window that is one phrase of at most half its words said over and over is no repeat of itself
further on in the same document (a stock line in a column stays); in a later document it is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import discard, fresh_long, saved
from votecount.llm.tokens import slices_by_bytes
from votecount.llm.words import BETWEEN_SPACES, Words, constants, mix, text_bytes, window_hashes, words_of

RUN = 50
GRAM = 15
#: Grams of a window.
_WIDTH = RUN - GRAM + 1
_WORD = constants(RUN, 15)


def anchors(grams: np.ndarray) -> np.ndarray:
    """The smallest of every ``_WIDTH`` grams in a row, one for each window."""
    low, width = grams, 1
    while width * 2 <= _WIDTH:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    more = _WIDTH - width
    return np.minimum(low[:-more], low[more:]) if more else low


def first_lowest(grams: np.ndarray) -> np.ndarray:
    """Where the smallest of every ``_WIDTH`` grams in a row stands, the first of equal ones."""
    at, width = np.arange(len(grams)), 1
    while width < _WIDTH:
        step = min(width, _WIDTH - width)
        a, b = at[:-step], at[step:]
        at, width = np.where(grams[b] < grams[a], b, a), width + step
    return at


def phrase_over(hashes: np.ndarray) -> np.ndarray:
    """For each window whether it is some phrase of at most ``RUN // 2`` words over and over."""
    found = np.zeros(len(hashes) - RUN + 1, bool)
    for q in range(1, RUN // 2 + 1):
        same = np.concatenate([[0], np.cumsum(hashes[:-q] == hashes[q:])])
        found |= (same[RUN - q :] - same[: q - RUN])[: len(found)] == RUN - q
    return found


def lines_of_words(texts: pa.Array, words: Words) -> np.ndarray:
    """The line, from 0 in its own text, that each word of a column lies in."""
    breaks = np.flatnonzero(words.data == 10)
    before = np.searchsorted(breaks, text_bytes(texts)[1])
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    return np.searchsorted(breaks, words.start) - before[owner]


def _left(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Every text of ``RUN`` words or more beside the lines that are gone: its row and the words' hashes."""
    words = words_of(batch.column("text"), BETWEEN_SPACES)
    line = lines_of_words(batch.column("text"), words)
    for i, gone in enumerate(batch.column("lines").to_pylist()):
        a, b = words.first[i], words.first[i + 1]
        if b - a < RUN:
            continue
        hashes = words.hash[a:b]
        if gone:
            hashes = hashes[~np.isin(line[a:b], gone)]
        if len(hashes) >= RUN:
            yield i, hashes


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of a text and at how many of its places each is met."""
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            rows, found, times = [], [], []
            for i, hashes in _left(batch):
                grams = window_hashes(hashes, GRAM)
                own = np.unique(anchors(grams))
                at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                found.append(own)
                times.append(np.bincount(at[own[at] == grams], minlength=len(own)))
                rows.append(np.full(len(own), i))
            if not rows:
                continue
            of = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("d1").take(of),
                    batch.column("d2").take(of),
                    pa.array(np.concatenate(found).view(np.int64)),
                    pa.array(np.minimum(np.concatenate(times), 2).astype(np.int32)),
                ],
                ["d1", "d2", "anchor", "times"],
            )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per place of an anchor asked for: its first window, the hash of each of its windows, and
    which of these (from 0) are one phrase over and over."""
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            asked = batch.column("wanted")
            for i, hashes in _left(batch):
                wanted = np.array(asked[i].as_py(), np.int64).view(np.uint64)
                grams = window_hashes(hashes, GRAM)
                lowest = first_lowest(grams)
                at = np.flatnonzero(np.isin(grams[lowest], wanted))
                if not len(at):
                    continue
                begin = np.flatnonzero(np.diff(lowest[at], prepend=-1))
                keys = np.zeros(len(at), np.uint64)
                for k in range(RUN):
                    keys += hashes[at + k] * _WORD[k]
                over = np.flatnonzero(phrase_over(hashes)[at])
                of = np.searchsorted(begin, over, "right") - 1
                row = pa.array(np.full(len(begin), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[lowest[at[begin]]].view(np.int64)),
                        *[batch.column(c).take(row) for c in ("id", "d1", "d2")],
                        pa.array(at[begin].astype(np.int32)),
                        pa.ListArray.from_arrays(np.append(begin, len(at)).astype(np.int32), mix(keys).view(np.int64)),
                        pa.ListArray.from_arrays(
                            np.searchsorted(of, np.arange(len(begin) + 1)).astype(np.int32),
                            (over - begin[of]).astype(np.int32),
                        ),
                    ],
                    ["anchor", "id", "d1", "d2", "pos", "windows", "over"],
                )


def _spans(runs: DataFrame, folder: str) -> DataFrame:
    """(anchor, span, n, head, last, met): every distinct run, where it is first and last, and for those of
    its windows (from 0) that are met before ``head`` in another run, where."""
    spans = runs.groupBy("anchor", "span", "n").agg(
        F.min("place").alias("head"), F.max("place").alias("last"), F.first("windows").alias("windows")
    )
    spans = saved(spans, f"{folder}/spans")
    # Windows of different runs can be equal only if their runs have one anchor.
    several = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1")
    several = several.select(fresh_long(F.col("anchor")).alias("key"))
    windows = spans.withColumn("key", fresh_long(F.col("anchor"))).join(several, "key")
    windows = windows.select("anchor", "span", "n", "head", F.posexplode("windows").alias("nth", "window"))
    windows = windows.withColumn("place", _moved("head", F.col("nth"))).drop("head")
    windows = saved(windows, f"{folder}/windows")
    firsts = windows.groupBy("anchor", "window").agg(F.min("place").alias("first"), F.max("place").alias("end"))
    firsts = firsts.where("first < end")
    firsts = firsts.select(fresh_long(F.col("window")).alias("key"), F.col("anchor").alias("also"), "first")
    met = windows.withColumn("key", fresh_long(F.col("window"))).join(firsts, "key")
    met = met.where("anchor = also and place <> first")
    met = met.groupBy("anchor", "span", "n").agg(F.map_from_entries(F.collect_list(F.struct("nth", "first"))).alias("met"))
    return spans.drop("windows").join(met, ["anchor", "span", "n"], "left")


def _moved(place: str, by: Column) -> Column:
    """A place further on in the same document."""
    return F.col(place).withField("pos", F.col(place)["pos"] + by)


def repeats(plain: DataFrame, gone: DataFrame, folder: str) -> DataFrame:
    """(d1, d2, starts, kept_in): the repeated windows by their first word among those that are left.

    ``plain`` has id, d1, d2 (which tell documents apart) and text, ``gone`` the lines (d1, d2, lines)
    that are removed already; what lies before and after those is taken as one run.
    """
    left = plain.join(gone.select("d1", "d2", "lines"), ["d1", "d2"], "left")
    met = left.select("d1", "d2", "text", "lines").mapInArrow(
        _anchored, "d1 bigint, d2 bigint, anchor bigint, times int"
    )
    met = saved(met, f"{folder}/anchors")
    shared = met.groupBy("anchor").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.max("times").alias("times"))
    shared = shared.where("a < b or times > 1").select(fresh_long(F.col("anchor")).alias("key"))
    shared = saved(shared, f"{folder}/shared")
    wanted = met.select("d1", "d2", fresh_long(F.col("anchor")).alias("key")).join(shared, "key")
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_set(fresh_long(F.col("key"))).alias("wanted"))
    wanted = saved(wanted, f"{folder}/wanted")
    discard(plain.sparkSession, f"{folder}/anchors", f"{folder}/shared")
    texts = left.join(wanted, ["d1", "d2"]).select("id", "d1", "d2", "text", "lines", "wanted")
    runs = texts.mapInArrow(
        _runs, "anchor bigint, id bigint, d1 bigint, d2 bigint, pos int, windows array<bigint>, over array<int>"
    )
    place = F.struct(F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("at"), "d1", "d2", "pos")
    runs = runs.select(
        "anchor", F.xxhash64("windows").alias("span"), F.size("windows").alias("n"), place.alias("place"), "over", "windows"
    )
    runs = saved(runs, f"{folder}/runs")
    spans = _spans(runs, folder).where("head < last or met is not null")
    spans = spans.select(fresh_long(F.col("span")).alias("key"), F.col("anchor").alias("also"), F.col("n").alias("m"), "head", "met")
    known = runs.drop("windows").withColumn("key", fresh_long(F.col("span"))).join(spans, "key").where("anchor = also and n = m")
    first = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda k: F.struct(
            k.alias("nth"),
            _moved("place", k).alias("own"),
            F.coalesce(F.try_element_at("met", k), _moved("head", k)).alias("first"),
        ),
    )
    elsewhere = lambda w: (w["own"]["d1"] != w["first"]["d1"]) | (w["own"]["d2"] != w["first"]["d2"])
    later = F.filter(
        first, lambda w: (w["own"] != w["first"]) & (~F.array_contains("over", w["nth"]) | elsewhere(w))
    )
    known = known.select(F.col("place.d1").alias("d1"), F.col("place.d2").alias("d2"), later.alias("later"))
    known = known.where(F.size("later") > 0).select(
        "d1", "d2",
        F.struct(
            F.transform("later", lambda w: w["own"]["pos"]).alias("starts"),
            F.array_distinct(
                F.transform(F.filter("later", lambda w: ~w["first"]["no"]), lambda w: w["first"]["at"])
            ).alias("ids"),
        ).alias("part"),
    )
    # Rows that repeat bring equal parts, so a group is bounded by the words of its text.
    parts = known.groupBy("d1", "d2").agg(F.collect_set("part").alias("parts"))
    return parts.select(
        "d1", "d2",
        F.array_distinct(F.flatten("parts.starts")).alias("starts"),
        F.array_distinct(F.flatten("parts.ids")).alias("kept_in"),
    )


CUT = "text string, removed array<int>, cut array<int>"


def cut(texts: pa.Array, lines: pa.Array, starts: pa.Array) -> pa.Array:
    """Texts without the lines that are gone and without the windows that begin at ``starts``.

    A line that loses all its words goes whole; of others the rest stays, joined by a blank. Null
    where there are no windows.
    """
    words = words_of(texts, BETWEEN_SPACES)
    raw, offset = text_bytes(texts)
    line_of = lines_of_words(texts, words)
    out = []
    for i, (gone, first) in enumerate(zip(lines.to_pylist(), starts.to_pylist(), strict=True)):
        if first is None:
            out.append(None)
            continue
        a, b = int(words.first[i]), int(words.first[i + 1])
        line, gone = line_of[a:b], set(gone or [])
        seen = np.flatnonzero(~np.isin(line, list(gone)))
        edge = np.zeros(len(seen) + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.array(first) + RUN, -1)
        covered = np.zeros(b - a, bool)
        covered[seen] = np.cumsum(edge[:-1]) > 0
        text = raw[offset[i] : offset[i + 1]].tobytes()
        kept, part, at = [], [], 0
        for n, content in enumerate(text.split(b"\n")):
            low, high = np.searchsorted(line, [n, n + 1])
            hit = covered[low:high]
            if n not in gone and not hit.any():
                kept.append(content)
            elif n not in gone and hit.all():
                gone.add(n)
            elif n not in gone:
                part.append(n)
                change = np.flatnonzero(np.diff(np.concatenate([[True], hit, [True]])))
                pieces = []
                for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                    s = 0 if x == 0 else words.start[a + low + x] - offset[i] - at
                    e = len(content) if y == high - low else words.end[a + low + y - 1] - offset[i] - at
                    pieces.append(content[s:e])
                kept.append(b" ".join(pieces))
            at += len(content) + 1
        out.append({"text": b"\n".join(kept).decode(), "removed": sorted(gone), "cut": part})
    kind = pa.list_(pa.int32())
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", kind), ("cut", kind)]))
