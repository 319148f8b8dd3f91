"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, number, distinct number and strength of lexicon words, how often one
stands within ``NEAR`` words of a second-person word, capitals, marks and obfuscation rates. The
lexicon is a short list of plain insults and what the training rows teach: words, and beginnings of
words (``STEM`` letters), that are far more frequent in toxic texts than in others. Labelled training
rows are split in three by the hash of their id: one part for the lexicon, one for the trees, one
for the calibration, so that none is judged by what it taught. Trees and calibration are Spark's own.

Fitting uses a bounded sample of the labelled rows, at most about ``SAMPLE`` rows drawn by the hash
of their id; scoring reads every text whole. Features of all rows are computed once, in Arrow
functions, and written to the shared folder; they are a few numbers a row.

Edge cases: a null or empty text has only zeros for features and is scored like any other; rows
without an id are scored but cannot be labelled; several labels of one id count as toxic if one of
them does; without training rows of both kinds the score is the share of toxic rows (0 without any);
repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import saved, shared_folder
from votecount.llm.tokens import slices_by_bytes

SAMPLE = 60_000
TREES, DEPTH = 20, 4
STEM = 4
NEAR = 5
LEXICON = 2000
#: A word is taken up if it is in at least so many toxic texts of the sample, and its share of toxic
#: texts is so many times its share of others (with one half added to both counts).
LEAST_TEXTS, LEAST_RATIO = 4, 8.0
LIMIT = 0.7
#: Plain insults, known before anything is learned (fixed values).
SEED = "bastard bitch damn disgusting dumb fool hate idiot jerk kill loser moron pathetic scum shit shut stupid trash ugly worthless".split()
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vuestro vuestra".split()
)
NAMES = (
    "n_words", "hits", "distinct", "density", "strength", "strongest", "near_second", "second_rate",
    "capitals", "capital_words", "marks", "doubled", "obfuscated", "stretched",
)

_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|"
_DOUBLED = re.compile(r"[!?]{2,}")
_OBFUSCATED = re.compile(r"[A-Za-z][0-9@$*#]+[A-Za-z]")
_STRETCHED = re.compile(r"([A-Za-z])\1{3,}")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def bare(words: list[str]) -> list[str]:
    return [w.strip(_EDGE) for w in words]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The numbers of ``NAMES``; a word counts by itself or, failing that, by its beginning."""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = bare(text.lower().split())
    get = lexicon.get
    met = [(i, w, s) for i, w in enumerate(words) if (s := get(w) or get(w[:STEM] + "*", 0.0))]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if met and second:
        # The next second-person word on either side of each hit.
        at = np.array([-NEAR - 1, *second, len(words) + NEAR + 1])
        hits = np.array([i for i, _, _ in met])
        after = np.searchsorted(at, hits)
        near = int((np.minimum(at[after] - hits, hits - at[after - 1]) <= NEAR).sum())
    upper = sum(map(str.isupper, raw)) / n
    letters = max(1, len(text))
    return [
        float(n),
        float(len(met)),
        float(len({w for _, w, _ in met})),
        len(met) / n,
        sum(s for _, _, s in met),
        max((s for _, _, s in met), default=0.0),
        float(near),
        len(second) / n,
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / letters,
        upper,
        (text.count("!") + text.count("?")) / n,
        len(_DOUBLED.findall(text)) / n,
        len(_OBFUSCATED.findall(text)) / n,
        len(_STRETCHED.findall(text)) / n,
    ]


def _labelled(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Ids, labels and parts (0 lexicon, 1 trees, 2 calibration) of a bounded sample of the rows to learn from."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_id")).agg((F.max(label) > 0).cast("double").alias("label"))
    n = known.count()
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    return known.where(drawn < F.lit(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3))
    )


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Words and beginnings (marked *) with their log ratios, from rows (text, label)."""
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    strong = {w: 3.0 for w in SEED}
    if not toxic or not clean:
        return strong

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                counts: dict[str, list[int]] = {}
                pairs = zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)
                for text, label in pairs:
                    words = {w for w in bare(text.lower().split()) if w}
                    for t in words | {w[:STEM] + "*" for w in words if len(w) > STEM}:
                        counts.setdefault(t, [0, 0])[int(label)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(counts.keys(), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
                    ["term", "clean", "toxic"],
                )

    found = texts.select(F.coalesce("text", F.lit("")).alias("text"), "label")
    found = found.mapInArrow(terms, "term string, clean bigint, toxic bigint")
    found = found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    found = found.withColumn("ratio", ratio).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO))
    best = found.orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "term").limit(LEXICON).collect()
    return strong | {r.term: float(np.log(r.ratio)) for r in best}


_ROW = "key bigint, " + ", ".join(f"{n} double" for n in NAMES)


def feature_table(docs: DataFrame, lexicon: dict[str, float], key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                found = np.array([features(t, shared.value) for t in batch.column("text").to_pylist()], float)
                found = found.reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), *(pa.array(found[:, i]) for i in range(len(NAMES)))], ["key", *NAMES]
                )

    return rows.mapInArrow(measured, _ROW)


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """Per row: key, held_out, score, predicted. Nothing is learned from held-out rows."""
    folder = shared_folder(docs.sparkSession)
    known = saved(_labelled(docs, labels, key, label), f"{folder}/labelled")
    plain = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("text"))
    # About SAMPLE rows of three numbers at most, so they can go to every task and no text is shuffled.
    lexicon = learn_lexicon(plain.join(F.broadcast(known.where("part = 0")), "_id").select("text", "label"))
    measured = saved(feature_table(docs, lexicon, key, text), f"{folder}/features")
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    taught = measured.join(F.broadcast(known.where("part > 0")), F.col("key") == F.col("_id")).select("label", "part", *NAMES)
    # The sample is bounded, and so small that one partition is the cheapest to pass over often.
    taught = saved(taught.coalesce(1), f"{folder}/taught")
    kinds = {(r.part, r.label) for r in taught.select("part", "label").distinct().collect()}
    out = F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out")
    if not {(1, 0.0), (1, 1.0), (2, 0.0), (2, 1.0)} <= kinds:
        share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        scored = measured.withColumn("p", F.lit(float(share)))
    else:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64, cacheNodeIds=False)
        model = trees.fit(vectors.transform(taught.where("part = 1")).select("features", "label"))

        def raw(df: DataFrame) -> DataFrame:
            found = model.transform(vectors.transform(df))
            return found.withColumn("raw", vector_to_array("probability")[1]).drop("features")

        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="p")
        fitted = steps.fit(raw(taught.where("part = 2")).select("raw", "label"))
        scored = fitted.transform(raw(measured).select("key", "raw"))
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*out, p.alias("score"), (p >= LIMIT).cast("int").alias("predicted"))
