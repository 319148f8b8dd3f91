"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of masks holds the filters of all languages: bit l of a cell belongs to language l. An
n-gram is hashed to ``PROBES`` cells, and the AND of their masks gives all languages that may hold
it at once. A text's n-grams are looked up together; per language the hits are counted and corrected
for the filter's false positives (its share of set cells to the power of the probes), and the
language with the largest corrected count is the answer.

N-grams are four bytes of UTF-8 after A-Z are lowered and every other ASCII byte that is no letter
has become a blank; those of blanks alone are left out. Training counts n-grams of labelled rows
(about ``ROWS_PER_LANGUAGE`` of each language, drawn by the hash of their text; a documented bound
on what a classifier may be fitted on) and keeps, per language, the ``GRAMS`` most frequent of those
that are at least ``CONTRAST`` as frequent there as in any other. The model is small and of bounded
size; texts to be told are never sampled and never cut.

Edge cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn from
all are ``und``; ties fall to the first language by name; repeated rows and null keys give a row
each; rows without a language teach nothing; an empty table gives an empty result. There is no
shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.llm.tokens import slices_by_bytes
from votecount.llm.words import constants, mix, text_bytes

GRAM = 4
ROWS_PER_LANGUAGE = 1500
GRAMS = 20_000
CONTRAST = 0.3
CELLS_PER_GRAM = 16
PROBES = 3
UNKNOWN = "und"
#: Characters of a text that are looked up at once.
PIECE = 1 << 20

#: Letters of ASCII in lower case and all bytes beyond ASCII stay, all else becomes a blank.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)
_BLANKS = np.uint32(0x20202020)
_PROBES = constants(8, 21)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts and the text each belongs to; a text has a blank at both ends."""
    raw, at = text_bytes(texts)
    n = len(at) - 1
    # Every text is set between two blanks of its own.
    data = np.full(len(raw) + 2 * n, 32, np.uint8)
    folded = _FOLDED[raw]
    for i in range(n):
        data[at[i] + 2 * i + 1 : at[i + 1] + 2 * i + 1] = folded[at[i] : at[i + 1]]
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    wide = data.astype(np.uint32)
    found = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    first = at + 2 * np.arange(n + 1)
    # N-grams that reach into the next text are counted as blanks, which are never looked up.
    for back in range(1, GRAM):
        edge = first[1:] - back
        found[edge[(edge >= 0) & (edge < len(found))]] = _BLANKS
    return found, np.minimum(first, len(found))


class Filters:
    """Bloom filters of several languages in one table of masks."""

    def __init__(self, languages: dict[str, np.ndarray], cells: int | None = None):
        self.names = sorted(languages)
        most = max((len(g) for g in languages.values()), default=1)
        self.bits = int(np.ceil(np.log2(max(1024, cells or most * CELLS_PER_GRAM))))
        self.planes = max(1, -(-len(self.names) // 8))
        # Eight languages to a plane of bytes.
        self.masks = np.zeros((self.planes, 1 << self.bits), np.uint8)
        for i, name in enumerate(self.names):
            for cell in self.cells(languages[name]):
                self.masks[i // 8][cell] |= np.uint8(1 << (i % 8))
        filled = [(self.masks[i // 8] >> np.uint8(i % 8) & 1).mean() for i in range(len(self.names))]
        self.false = np.array(filled) ** PROBES

    def cells(self, found: np.ndarray) -> list[np.ndarray]:
        wide = mix(found.astype(np.uint64) * _PROBES[0])
        step = np.uint64(64 - self.bits)
        return [(wide * _PROBES[1 + k]) >> step for k in range(PROBES)]

    def hits(self, found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: hits by language and the number of n-grams looked up."""
        real = found != _BLANKS
        total = np.diff(np.concatenate([[0], np.cumsum(real)])[first])
        hits = np.zeros((len(first) - 1, len(self.names)))
        cells = self.cells(found)
        for plane in range(self.planes):
            mask = self.masks[plane][cells[0]]
            for cell in cells[1:]:
                mask &= self.masks[plane][cell]
            mask[~real] = 0
            for i in range(8 * plane, min(8 * plane + 8, len(self.names))):
                sums = np.concatenate([[0], np.cumsum(mask >> np.uint8(i % 8) & 1, dtype=np.int64)])
                hits[:, i] = np.diff(sums[first])
        return hits, total

    def whole_hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``hits`` of texts of any length; a very long one is looked up piece by piece."""
        values = texts.to_pylist()
        if all(len(t or "") <= PIECE for t in values):
            return self.hits(*grams(texts))
        hits, total = np.zeros((len(values), len(self.names))), np.zeros(len(values))
        for i, t in enumerate(values):
            for k in range(0, len(t or ""), PIECE):
                h, n = self.hits(*grams(pa.array([t[k : k + PIECE]], pa.large_string())))
                hits[i] += h[0]
                total[i] += n[0]
        return hits, total

    def decide(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        hits, total = self.whole_hits(texts)
        kept = np.maximum(0, (hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = kept.argmax(axis=1)
        sums = kept.sum(axis=1)
        share = np.where(sums > 0, kept.max(axis=1) / np.maximum(sums, 1e-9), 1 / len(self.names))
        names, scores = [], []
        for i, text in enumerate(texts):
            if lettered(text):
                names.append(self.names[best[i]])
                scores.append(float(share[i]))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
        return names, scores


def lettered(text: pa.StringScalar) -> bool:
    value = text.as_py()
    return value is not None and any(map(str.isalpha, value))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all languages of the labelled rows given, about ``rows`` rows of each."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # One count per language, so that no text is shuffled to draw the sample.
    sizes = named.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, rows / r.n)]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    drawn = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = named.where(drawn < F.element_at(share, F.col(lang)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                found, first = grams(batch.column("text"))
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                names = np.array(batch.column("lang").to_pylist(), object)
                for name in sorted(set(names)):
                    mine = found[: len(owner)][(names == name)[owner]]
                    gram, times = np.unique(mine[mine != _BLANKS], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram)), pa.array(gram, pa.int64()), pa.array(times, pa.int64())],
                        ["lang", "gram", "n"],
                    )

    counts = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        counted, "lang string, gram bigint, n bigint"
    )
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"))
    kept = rates.join(highest, "gram").where(F.col("rate") >= CONTRAST * F.col("highest"))
    ranked = kept.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rate", "gram")), asc=False).alias("g"))
    model = ranked.select("lang", F.expr(f"transform(slice(g, 1, {GRAMS}), x -> x.gram)").alias("g"))
    return Filters({r.lang: np.array(r.g, np.uint32) for r in model.collect()})


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", 1 << 20):
                names, scores = shared.value.decide(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["key", "lang_pred", "score"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(told, f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def learn_and_identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, held_out, lang_pred, score. Nothing is learned from held-out rows."""
    filters = fit(docs.where(~held_out(F.col(key))), text=text, lang=lang)
    found = identify(docs, filters, key, text)
    return found.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "lang_pred", "score")
