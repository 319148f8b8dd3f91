"""Repair of digits misread as look-alike characters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import strict_int, translated, trim_all


def ocr_digit(c: Column) -> Column:
    """Digit behind one character; anything unknown counts as 0."""
    return F.coalesce(strict_int(translated(c, K.LOOKALIKES_DIGIT)), F.lit(0)).cast("int")


def ocr_number(c: Column) -> Column:
    """Number behind a blank-separated digit string; unreadable text counts as 0."""
    packed = trim_all(F.replace(c, F.lit(" "), F.lit("")))
    return F.coalesce(strict_int(translated(packed, K.LOOKALIKES_NUMBER)), F.lit(0))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def repaired_field(c: Column) -> Column:
    """Numeric field with known substitutions applied and other letters shown as '?'."""
    kept = F.regexp_replace(c, r"[^0-9A-Za-z|]", "")
    return translated(kept, dict.fromkeys(K.SUSPICIOUS_LETTERS, "?") | K.LOOKALIKES_FIELD)


def is_suspicious(c: Column) -> Column:
    """True when a numeric field holds a letter that stands for no digit."""
    return c.rlike("[" + "".join(x for x in K.SUSPICIOUS_LETTERS if x not in K.LOOKALIKES_FIELD) + "]")


def choose_pass(a: Column, b: Column) -> Column:
    """The second text only when it has over 20 more digits than the first."""
    richer = F.length(digits_only(b)) > F.length(digits_only(a)) + 20
    return F.when(richer, b).otherwise(a)


def text_is_usable(c: Column) -> Column:
    """Long enough (over 20 bytes) and with at least one digit."""
    body = trim_all(c)
    return (F.octet_length(body) > 20) & body.rlike("[0-9]")
