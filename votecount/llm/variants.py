"""Spelling variants: an index of grams of variable length finds words that differ by one edit.

1. Words are counted with built-in functions, a map-side combine before one shuffle.
2. The gram dictionary grows from pairs of letters: a gram is lengthened, up to ``QMAX``, as long as
   it occurs more than ``MANY`` times among the words (more in huge vocabularies, so that at most
   ``ENTRIES`` frequent grams exist, which bounds what each task is sent). Frequent grams so give
   way to longer, rarer ones, and the lists of the index stay short.
3. A word, between a start and an end mark, is decomposed: at every place the gram that the
   dictionary allows, left out if an earlier one covers it.
4. For every place of an edit the grams that it may change are counted (those over the place, and
   those to the right that a gram lengthened by the edit may cover). The largest count is the
   word's bound: two words one edit apart share all but that many grams of either.
5. So they meet in the rarest bound + 1 grams of both, and only those lists are merged: a join on gram
   and length. Pairs that share fewer grams than the bounds ask for are passed over, the others
   verified by their edit distance. Words whose bound leaves no gram certain take all their grams;
   for two such words the halves of the words are grams too, one of which an edit leaves whole.
6. A word's form is its most frequent near word if that is frequent enough, and forms are followed to
   their end by doubling the steps; there are as many rounds as the growing counts allow at most.

No list is cut: a frequent gram costs time, not results, and run-time skew handling splits it.

Edge cases: a null text has no words; a null id counts as an empty text where an id goes into a
check sum; repeated rows are counted again. Words of any length are taken, in time that grows with
the length. Words without a near one have ``n_near`` 0, no form, and are their own root. Among near
words with equal counts the first in code-point order is the form. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votecount.llm.common import ascii_lower, saved, shared_folder

RUN = "[A-Za-zÀ-ÿ]+"
#: Longest gram; occurrences from which a gram is lengthened; frequent grams at most.
QMAX, MANY, ENTRIES = 4, 64, 65536
_DECOMPOSED = "word string, n bigint, len int, grams array<string>, sure int, bound int, halves array<string>"
_SCHEMA = pa.schema(
    [("word", pa.string()), ("n", pa.int64()), ("len", pa.int32()), ("grams", pa.list_(pa.string())),
     ("sure", pa.int32()), ("bound", pa.int32()), ("halves", pa.list_(pa.string()))]
)


def counted_words(docs: DataFrame, slips: int = 199, length: int = 6, least: int = 5) -> DataFrame:
    """(word, n): runs of letters in lower case; one in ``slips`` check sums loses a letter."""
    run, id_ = F.col("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    sum_ = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(sum_, F.char_length(run)).cast("int")
    slipped = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    words = runs.where(F.char_length(run) >= length).select(F.when(sum_ % slips == 0, slipped).otherwise(run).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.char_length("word") >= length) & (F.col("n") >= least))


def decompose(word: str, frequent: frozenset[str], qmax: int = QMAX) -> tuple[str, list[tuple[int, int]]]:
    """The marked word and the places (from, to) of its grams, both ends rising."""
    s = f"^{word}$"
    grams, end = [], 0
    for a in range(len(s) - 1):
        b = a + 2
        while b < len(s) and b - a < qmax and s[a:b] in frequent:
            b += 1
        if b > end:
            grams.append((a, b))
            end = b
    return s, grams


def most_changed(s: str, grams: list[tuple[int, int]], suffixes: frozenset[str], qmax: int = QMAX) -> int:
    """How many different grams one edit may change at most, over all its places.

    An edit at place j changes the grams over j. Those left of it were chosen by letters left of it
    and stay. One right of it, up to ``b``, stays what it is, but is left out if a gram that begins
    at or before the edit now reaches b; such a gram is one letter longer than a frequent one that
    ends in the letters from j + 1 to b - 1, so there is none unless those end a frequent gram.
    """
    most, begin = 0, 0
    for j in range(len(s) - 1):
        while grams[begin][1] <= j:
            begin += 1
        changed = set()
        for a, b in grams[begin:begin + 2 * qmax]:
            if b > j + qmax and a > j:
                break
            if a <= j or s[j + 1 : b - 1] in suffixes:
                changed.add(s[a:b])
        most = max(most, len(changed))
    return most


def halves(word: str) -> list[str]:
    """Keys of which a word shares one with any other that is one edit away and also has them."""
    out = []
    for m in (len(word), len(word) - 1):  # the length of the shorter of two words
        h = m // 2
        out += [f"<{m}:{word[:h]}", f">{m}:{word[len(word) - (m - h):]}"]
    return out


def _suffixes(frequent: frozenset[str]) -> frozenset[str]:
    return frozenset(g[i:] for g in frequent for i in range(1, len(g)))


def _decomposer(frequent: frozenset[str], qmax: int):
    suffixes = _suffixes(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                s, places = decompose(word, frequent, qmax)
                grams = sorted({s[a:b] for a, b in places})
                most = most_changed(s, places, suffixes, qmax)
                sure = len(grams) - most
                rows.append(
                    {"word": word, "n": n, "len": len(word), "grams": grams, "sure": sure,
                     "bound": most if sure > 0 else len(grams), "halves": [] if sure > 0 else halves(word)}
                )
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def near_pairs(words: DataFrame, folder: str, qmax: int = QMAX, many: int = MANY) -> DataFrame:
    """(a, n_a, b, n_b) once for every two words of (word, n) that are one edit apart."""
    spark = words.sparkSession
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    places = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0))).first()[0] * max(1, qmax - 2)
    grams = words.select(marked.alias("s")).select("s", F.explode(F.sequence(F.lit(2), F.lit(max(2, qmax - 1)))).alias("q"))
    grams = grams.where(F.char_length("s") >= F.col("q"))
    grams = grams.select("s", "q", F.explode(F.sequence(F.lit(1), F.char_length("s") - F.col("q") + 1)).alias("i"))
    counts = grams.groupBy(F.substring("s", F.col("i"), F.col("q")).alias("gram")).agg(F.count(F.lit(1)).alias("f"))
    # No more grams than ENTRIES can be above their share of all places.
    kept = counts.where(F.col("f") > max(many, places // ENTRIES))
    frequent = frozenset(kept.toArrow().column("gram").to_pylist()) if qmax > 2 else frozenset()

    parts = saved(words.mapInArrow(_decomposer(frequent, qmax), _DECOMPOSED), f"{folder}/grams")
    lists = parts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    by_rarity = parts.select("word", F.explode("grams").alias("gram")).join(lists, "gram")
    ranked = by_rarity.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("ranked"))
    asked = parts.join(ranked, "word").select(
        "word", "n", "len", "sure", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"),
        F.explode(F.concat(F.transform(F.slice("ranked", 1, F.col("bound") + 1), lambda r: r["gram"]), "halves")).alias("gram"),
    )
    asked = saved(asked, f"{folder}/lists")
    left = asked.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("sure").alias("sure_a"), F.col("grams").alias("grams_a"),
        F.col("gram"), F.col("len").alias("len_a"), F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("len"),
    )
    right = asked.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("sure").alias("sure_b"), F.col("grams").alias("grams_b"), "gram", "len"
    )
    shared = F.size(F.array_intersect("grams_a", "grams_b")) >= F.greatest("sure_a", "sure_b")
    met = left.join(right, ["gram", "len"]).where(((F.col("len") > F.col("len_a")) | (F.col("a") < F.col("b"))) & shared)
    # The distance function answers -1 beyond its limit.
    one_edit = met.where(F.levenshtein("a", "b", 1) == 1)
    return saved(one_edit.select("a", "n_a", "b", "n_b").distinct(), f"{folder}/pairs")


def _followed(forms: DataFrame, most: int, ratio: int, folder: str) -> DataFrame:
    """(word, root) of (word, form): every step multiplies a count, so few steps reach the end."""
    steps = math.ceil(math.log(max(most, ratio), ratio)) + 1
    at = forms.select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        at = saved(at, f"{folder}/roots-{k}")
    return at


def variants(docs: DataFrame, ratio: int = 5, slips: int = 199, length: int = 6, least: int = 5) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    folder = shared_folder(docs.sparkSession)
    words = saved(counted_words(docs, slips, length, least), f"{folder}/words")
    pairs = near_pairs(words, folder)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    # A word of L letters has some hundred times L possible neighbours at most.
    mine = Window.partitionBy("a")
    best = both.withColumns(
        {"n_near": F.count(F.lit(1)).over(mine), "_k": F.row_number().over(mine.orderBy(F.desc("n_b"), "b"))}
    ).where("_k = 1")
    found: Column = F.col("n_b") >= F.col("n_a") * ratio
    best = best.select(F.col("a").alias("word"), "n_near", F.when(found, F.col("b")).alias("form"), F.when(found, F.col("n_b")).alias("form_n"))
    best = saved(best, f"{folder}/best")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _followed(best.where(F.col("form").isNotNull()), most, ratio, folder)
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"
    )


#: Plain SQL for the rows of ``variants``: the check sum by its table, neighbours by left-out letters.
SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT i, c FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), keys AS (
  SELECT id, run, count(*) AS times, concat(id, ':', run) AS key FROM runs WHERE length(run) >= 6 GROUP BY id, run
), steps(id, run, bytes, c) AS (
  SELECT id, run, hex(encode(key)), 4294967295::BIGINT FROM keys
  UNION ALL
  SELECT s.id, s.run, substr(s.bytes, 3), xor(s.c >> 8, crc.c)
  FROM steps s JOIN crc ON crc.i = xor(s.c & 255, CAST(concat('0x', left(s.bytes, 2)) AS BIGINT))
  WHERE s.bytes <> ''
), summed AS (
  SELECT id, run, xor(c, 4294967295) AS h FROM steps WHERE bytes = ''
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word,
    CAST(sum(times) AS BIGINT) AS n
  FROM keys JOIN summed USING (id, run) GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), shorter AS (
  SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS m
  FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1
), forms AS (
  SELECT word, other AS form, m AS form_n FROM best WHERE m >= 5 * n
), path(word, top) AS (
  SELECT word, word FROM words
  UNION ALL
  SELECT p.word, f.form FROM path p JOIN forms f ON p.top = f.word
), roots AS (
  SELECT p.word, p.top AS root FROM path p ANTI JOIN forms f ON p.top = f.word
)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
"""
