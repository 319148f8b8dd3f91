"""Benchmark decontamination by Wu-Manber search for all windows of the benchmark at once.

Symbols are words. For windows of equal length (ten words; short items make shorter ones) a shift
table tells from the block of the last two words under the cursor how far no window can end; where
the shift is zero, the block's hash selects the windows that end in it, and direct comparison of
the words' bytes confirms an occurrence. All texts of a batch are scanned in step: every text is cut
into stretches of window ends, each with its own cursor, and one array operation moves all cursors.

The benchmark is small against the corpus, but its size is checked: its windows are sent to the
workers in groups of at most ``GROUP_BYTES`` of text, one pass over a row per group, so a large
benchmark costs time and not memory. Documents are never shuffled or collected.

Edge cases: a null or empty text has no words and no hits; a null or empty item has no window; an
item with a null id marks words but is not counted or listed; repeated items count once by their
id; repeated documents give a row each; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.tokens import slices_by_bytes
from votecount.llm.words import ALPHANUMERIC, Words, constants, mix, window_hashes, words_of

WINDOW = 10
GROUP_BYTES = 16 << 20
#: Window ends that one cursor visits.
STRETCH = 256
_C = constants(2, 7)


def _blocks(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of words that ends at each place."""
    if size == 1:
        return mix(words[ends] * _C[1])
    return mix(words[ends - 1] * _C[0] + words[ends] * _C[1])


class Search:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, tuple[np.ndarray, list[str]]]):
        self.length, self.block = length, min(2, length)
        self.texts = list(windows)
        self.items = [windows[t][1] for t in self.texts]
        words = np.array([windows[t][0] for t in self.texts], np.uint64).reshape(-1, length)
        size = 1 << max(12, int(np.ceil(np.log2(8 * max(1, words.size)))))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.block + 1, np.uint8)
        for end in range(self.block - 1, length):
            column = np.full(len(words), end)
            hashes = _blocks(words.ravel(), column + np.arange(len(words)) * length, self.block)
            np.minimum.at(self.shift, hashes & self.mask, np.uint8(length - 1 - end))
        # In a suffix bucket the windows lie in the order of their fingerprints.
        suffix = _blocks(words.ravel(), (np.arange(len(words)) + 1) * length - 1, self.block)
        whole = np.array([window_hashes(w, length)[0] for w in words], np.uint64)
        key = mix(suffix + whole)
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def occurrences(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ends (the last word's number) and windows of all occurrences."""
        hashes, m = found.hash, self.length
        low, high = found.first[:-1] + m - 1, found.first[1:]
        n = np.maximum(0, -(-(high - low) // STRETCH))
        at = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        limit = np.minimum(at + STRETCH, np.repeat(high, n))
        met = []
        while at.size:
            step = self.shift[_blocks(hashes, at, self.block) & self.mask]
            hit = step == 0
            if hit.any():
                met.append(at[hit])
            at = at + np.where(hit, 1, step)
            on = at < limit
            at, limit = at[on], limit[on]
        ends = np.concatenate(met) if met else np.zeros(0, np.int64)
        whole = np.zeros(len(ends), np.uint64)
        if len(ends):
            whole = window_hashes(hashes, m)[ends - m + 1]
        key = mix(_blocks(hashes, ends, self.block) + whole)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[place] == key
        ends, windows = ends[same], self.order[place[same]]
        sure = [found.joined(e - m + 1, e + 1) == self.texts[w] for e, w in zip(ends.tolist(), windows.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return ends[sure], windows[sure]


def searches(items: list[tuple[str | None, str]], length: int = WINDOW) -> list[Search]:
    """One search per window length that the items call for."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list[str]]]] = {}
    found = words_of(pa.array([t for _, t in items], pa.large_string()), ALPHANUMERIC)
    for i, (item, _) in enumerate(items):
        a, b = int(found.first[i]), int(found.first[i + 1])
        m = min(length, b - a)
        for s in range(a, b - m + 1) if m else ():
            _, ids = by_length.setdefault(m, {}).setdefault(found.joined(s, s + m), (found.hash[s : s + m], []))
            if item is not None and item not in ids:
                ids.append(item)
    return [Search(m, windows) for m, windows in sorted(by_length.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_HITS = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("upto", pa.int64())]))),
     ("items", pa.list_(pa.string()))]
)
_HITS_SQL = "struct<n_words:bigint,spans:array<struct<from:bigint,upto:bigint>>,items:array<string>>"


def _scan(texts: pa.Array, tables: list[Search], before: list[dict | None]) -> pa.Array:
    found = words_of(texts, ALPHANUMERIC)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for i, b in enumerate(before):
        if b is not None and b["spans"]:
            spans[i] = [(s["from"], s["upto"]) for s in b["spans"]]
            items[i] = set(b["items"])
    for search in tables:
        ends, windows = search.occurrences(found)
        owner = np.searchsorted(found.first, ends, "right") - 1
        local = ends - found.first[owner]
        for doc, e, w in zip(owner.tolist(), local.tolist(), windows.tolist(), strict=True):
            spans.setdefault(doc, []).append((e - search.length + 1, e + 1))
            items.setdefault(doc, set()).update(search.items[w])
    counts = np.diff(found.first).tolist()
    rows = [
        {
            "n_words": n,
            "spans": [{"from": s, "upto": e} for s, e in _merged(spans.get(i, []))],
            "items": sorted(items.get(i, ())),
        }
        for i, n in enumerate(counts)
    ]
    return pa.array(rows, _HITS)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    length: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and, in the struct ``__hits``, n_words, merged spans and item ids."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    rows = rows.where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    df = docs.withColumn("__hits", F.lit(None).cast(_HITS_SQL))
    for g in range(groups):
        # At most about group_bytes of benchmark text at once.
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        df = df.mapInArrow(_scanner(shared, text, length), df.schema)
    return df


def _scanner(shared, text: str, length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searches(shared.value, length)
        for whole in batches:
            for batch in slices_by_bytes(whole, text):
                at = batch.schema.get_field_index("__hits")
                hits = _scan(batch.column(text), tables, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [hits if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names
                )

    return scan


def verdicts(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select(key, text), benchmark, text, **options)
    hit = F.aggregate("__hits.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["upto"] - s["from"])
    return found.select(
        key,
        F.col("__hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__hits.items"), ","), 256).alias("items_sha256"),
        (F.size("__hits.spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a benchmark window, in their own columns."""
    found = find(docs, benchmark, text, **options)
    return found.where(F.size("__hits.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH ow AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), dg AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM ow, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hit AS (
  SELECT doc_id, item_id, i, m FROM dg JOIN win USING (m, g)
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit,
  coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256,
  coalesce(n_hit.n, 0) > 0 AS contaminated
FROM ow LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
