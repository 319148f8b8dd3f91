"""Line-first cleaning with built-in expressions only.

Every line is judged by itself: punctuation (it ends no sentence, or doubled marks or symbols
outweigh its words), navigation (a row of separators) and boilerplate (a short line with a stock
phrase). Failed lines are removed; a document is rejected if it fails the base rules (too few
words, too many words in repeated five-word windows) or loses more than half of its word
characters with the removed lines.

Edge cases: a null or blank text has no words and is rejected; lines without a word pass; a
repeated row is judged like the first; other columns pass through whatever their names; an empty
table gives an empty result. All work is within a row, so there is no shuffle and no hot key, and
every step is linear in the text but for one sort of the windows of texts that do repeat some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.functions.steps import once
from votecount.llm.common import SPACE

MIN_WORDS = 10
MAX_REPEATED_PCT = 20
MAX_LOST_PCT = 50
WINDOW = 5
#: Symbols counted by ``n_symbols``.
SYMBOLS = r"[#*$%&|<>]"
#: A sentence end: a mark, closing quotes or brackets, then white space or the end of the line.
SENTENCE_END = r"""[.!?…。！？]["')\]»”’]*([\x20\x09-\x0D]|$)"""
SHOUT = r"[!?]{2,}"
SEPARATORS = r"[|»›•·]"
#: Stock phrases, sought without regard to case in lines of at most ``SHORT_LINE`` words.
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie",
    "copyright",
    "javascript",
    "licensed under",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "released under",
    "sign up",
    "skip to content",
    "subscribe",
    "terms of service",
    "terms of use",
)
SHORT_LINE = 20
#: Tenths of marks or symbols per word above which a line fails.
MAX_MARKS_TENTHS = 3
MIN_SEPARATORS = 3


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def _passes(line: Column, n: Column, symbols: Column) -> Column:
    """The verdict on one line of ``n`` words; lines without a word pass."""
    boilerplate = (n <= SHORT_LINE) & F.lower(line).rlike("|".join(PHRASES))
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= MIN_SEPARATORS
    marks = F.regexp_count(line, F.lit(SHOUT)) + symbols
    punctuation = ~line.rlike(SENTENCE_END) | (marks * 10 > n * MAX_MARKS_TENTHS)
    return (n == 0) | ~(punctuation | navigation | boilerplate)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, in the struct ``__q``, what the rules found.

    ``__q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    lost_chars, base_failed, kept, and clean_text (the text without its failed lines).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = once(docs, {"__l": F.split(whole, "\n")})
    df = once(df, {"__lw": F.transform("__l", _words)})
    df = once(
        df,
        {
            "__w": F.flatten("__lw"),
            "__ln": F.transform("__lw", F.size),
            "__ls": F.transform("__l", lambda line: F.regexp_count(line, F.lit(SYMBOLS))),
        },
    ).drop("__lw")
    n = F.size("__w")
    hashed = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    ok = F.transform("__l", lambda line, i: _passes(line, F.get("__ln", i), F.get("__ls", i)))
    df = once(df, {"__h": hashed, "__ok": ok})
    # Windows in the order of their hashes, of those texts only in which two are alike.
    ordered = F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    good = F.filter("__l", lambda _, i: F.get("__ok", i))
    df = once(df, {"__o": ordered, "__good": good})
    twice = F.filter(
        "__o",
        lambda x, i: x["h"].eqNullSafe(F.get("__o", i - 1)["h"]) | x["h"].eqNullSafe(F.get("__o", i + 1)["h"]),
    )
    df = once(df, {"__at": F.sort_array(F.transform(twice, lambda x: x["i"]))})
    # Each repeated window adds the words up to the next one, five at most.
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get("__at", i + 1) - p), F.lit(WINDOW))),
        F.lit(0),
        lambda a, b: a + b,
    )
    worded = F.filter("__l", lambda _, i: F.get("__ln", i) > 0)
    removed = F.size("__l") - F.size("__good")
    lost = F.when(
        removed > 0, F.length(F.array_join("__w", "")) - F.length(F.regexp_replace(F.array_join("__good", ""), SPACE, ""))
    ).otherwise(0)
    df = once(
        df,
        {
            "__n": n.cast("bigint"),
            "__chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "__symbols": F.aggregate("__ls", F.lit(0), lambda a, b: a + b).cast("bigint"),
            "__dup": (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint"),
            "__rep": covered.cast("bigint"),
            "__removed": removed.cast("bigint"),
            "__lost": lost.cast("bigint"),
        },
    )
    base_failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__rep") > MAX_REPEATED_PCT * F.col("__n"))
    return df.select(
        *docs.columns,
        F.struct(
            F.col("__n").alias("n_words"),
            F.col("__chars").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.col("__dup").alias("n_dup_lines"),
            F.col("__rep").alias("n_repeat_words"),
            F.col("__removed").alias("n_lines_removed"),
            F.col("__lost").alias("lost_chars"),
            base_failed.alias("base_failed"),
            (~base_failed & (100 * F.col("__lost") <= MAX_LOST_PCT * F.col("__chars"))).alias("kept"),
            F.array_join("__good", "\n").alias("clean_text"),
        ).alias("__q"),
    )


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the counts and the verdict."""
    found = clean(docs.select(key, text), text)
    return found.select(key, "__q.*").drop("clean_text")


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, in their own columns, without their failed lines."""
    found = clean(docs, text).where("__q.kept")
    return found.select(
        *[F.col("__q.clean_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )


_PHRASES_SQL = "|".join(PHRASES)
_END_SQL = SENTENCE_END.replace("'", "''")

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, t, w,
    list_transform(string_split(t, chr(10)), lambda x: {{
      'x': x,
      'n': len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')),
      'c': coalesce(list_sum(list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: length(y))), 0),
      'bad': NOT regexp_matches(x, '{_END_SQL}')
        OR (len(regexp_extract_all(x, '{SHOUT}')) + len(regexp_extract_all(x, '[#*$%&|<>]'))) * 10
           > {MAX_MARKS_TENTHS} * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
        OR len(regexp_extract_all(x, '{SEPARATORS}')) >= {MIN_SEPARATORS}
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= {SHORT_LINE}
            AND regexp_matches(lower(x), '{_PHRASES_SQL}'))
    }}) AS ls,
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS g
  FROM d
), r AS (
  SELECT *, list_histogram(g) AS m FROM l
), p AS (
  SELECT *, list_filter(range(1, len(g) + 1), lambda i: m[g[i]] > 1) AS pos,
    list_filter(ls, lambda x: x.n > 0) AS lw
  FROM r
), c AS (
  SELECT doc_id,
    len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lw) - len(list_distinct(list_transform(lw, lambda x: x.x))))::BIGINT AS n_dup_lines,
    coalesce(list_sum(list_transform(range(1, len(pos) + 1),
      lambda i: least(5, coalesce(pos[i + 1] - pos[i], 5)))), 0)::BIGINT AS n_repeat_words,
    len(list_filter(lw, lambda x: x.bad))::BIGINT AS n_lines_removed,
    coalesce(list_sum(list_transform(list_filter(lw, lambda x: x.bad), lambda x: x.c)), 0)::BIGINT AS lost_chars
  FROM p
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words AS base_failed FROM c
)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PCT} * word_chars AS kept FROM b
"""
