"""Small column expressions shared by the parsers, rules and reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every Unicode white space character (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_all(c: Column) -> Column:
    """Strip every kind of white space from both ends (plain trim strips blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strict_int(c: Column) -> Column:
    """Whole-string signed integer, NULL for anything else or on overflow."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))


def prefix_int(c: Column) -> Column:
    """Integer at the start of the text ("12abc" is 12), NULL when there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def numeric_code(acta_id: Column) -> Column:
    """Numeric sheet code behind an id such as MESA-123; 0 means "no code"."""
    bare = trim_all(F.regexp_replace(acta_id, r"^MESA-", ""))
    return F.coalesce(strict_int(bare), F.lit(0).cast("bigint"))


def pct(part: Column, whole: Column) -> Column:
    """part / whole * 100 with 0 on an empty base."""
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))


def positive_pct(part: Column, whole: Column) -> Column:
    """Like pct, but a base below zero also yields 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def ratio_2dec(part: Column, whole: Column) -> Column:
    """Percentage rounded half up to two decimals; 0 unless the base is positive."""
    return F.when(whole > 0, F.round(part / whole * 10000) / 100).otherwise(F.lit(0.0))


def half_even_1dec(c: Column) -> Column:
    return F.rint(c * 10) / 10


def total_or_zero(c) -> Column:
    """Sum that is 0 instead of NULL when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def join_first(items: Column, n: int, total: Column | None = None) -> Column:
    """First n texts joined, followed by how many more there are (of ``total``, or of ``items``)."""
    total = F.size(items) if total is None else total
    head = F.array_join(F.slice(items, 1, n), "; ")
    more = F.concat(F.lit(" (y "), (total - n).cast("string"), F.lit(" más)"))
    return F.when(total <= n, head).otherwise(F.concat(head, more))


def compact(*items: Column) -> Column:
    """Array of the given texts without the NULL ones, in order."""
    return F.array_compact(F.array(*items))


def sum_votes(candidates: Column) -> Column:
    """Votes of all entries of a candidate array."""
    return F.aggregate(
        candidates, F.lit(0).cast("bigint"), lambda acc, c: acc + c["votos"].cast("bigint")
    )


def translated(c: Column, table: dict[str, str]) -> Column:
    """Each character of the table replaced by its partner."""
    return F.translate(c, "".join(table), "".join(table.values()))
