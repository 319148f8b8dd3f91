"""Per-key facts attached to every row, without ever gathering a key in one task.

A window partitioned by a key sends all rows of that key to one task, which breaks when
one key holds a third of the table. Here the per-key facts are aggregated first (partial
aggregation shrinks a hot key to one row per map task) and then joined back. The join is on
a key of its own, so that both of its sides are shuffled for it, and a partition that a hot
key makes large is split at run time (``session.py`` asks for that). Rows that look nothing
up are spread instead of meeting in one partition.

Nothing runs while the plan is built, and no row is dropped, capped or sampled on the way.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFT = Decimal(10**19)
_LAST = 10**18 - 1


def attach(
    df: DataFrame,
    key: str,
    facts: dict[str, Column],
    row_id: str,
    among: Column | None = None,
    min_rows: int = 1,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the aggregates ``facts`` of each row's key group to the row.

    ``among`` limits both which rows are counted and which rows get the facts; ``min_rows``
    leaves out groups with fewer counted rows. Facts are NULL wherever left out, which keeps
    the joined side small when only repeated keys matter. ``source`` is a narrower frame of
    the same rows to aggregate, where ``df`` has columns that are costly to work out.
    """
    takes_part = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    rows = df if source is None else source
    # Rows left out share one NULL group instead of being filtered: a filter would be pushed
    # below whatever computes ``among`` and evaluate that twice.
    grouped = rows.groupBy(key) if among is None else rows.groupBy(F.when(takes_part, F.col(key)).alias(key))
    packed = (
        grouped.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in facts.items()])
        .where(F.col(key).isNotNull() & (F.col("_rows") >= min_rows))
        .select(_look_up(F.col(key)).alias("_clave"), F.struct(*facts).alias("_facts"))
    )
    spread = F.concat(F.lit("-"), F.col(row_id).cast("string"))
    asked = F.when(takes_part & F.col(key).isNotNull(), _look_up(F.col(key))).otherwise(spread)
    joined = df.withColumn("_clave", asked).join(packed, "_clave", "left")
    return joined.select(*df.columns, *[F.col(f"_facts.{n}").alias(n) for n in facts])


def _look_up(key: Column) -> Column:
    return F.concat(F.lit("="), key.cast("string"))


def stamp(when: Column, seq: Column, bit: Column | None = None, missing: int = _LAST) -> Column:
    """Arrival order (and one flag) as a single fixed-width number.

    The minimum of a number is kept in place by hash aggregation; the minimum of a struct
    would sort all rows first. ``seq`` is unique, not negative and below 10**18.
    A NULL time counts as ``missing``, by default later than all others.
    """
    time = F.coalesce(F.unix_micros(when), F.lit(missing)).cast("decimal(18,0)") * F.lit(_SHIFT)
    low = seq.cast("decimal(18,0)") * F.lit(Decimal(10))
    if bit is not None:
        low = low + bit.cast("int").cast("decimal(1,0)")
    return (time + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def stamp_seq(c: Column) -> Column:
    """The sequence number in a stamp."""
    return F.floor(F.pmod(c, F.lit(_SHIFT)) / 10).cast("bigint")


def stamp_bit(c: Column) -> Column:
    return F.pmod(c, F.lit(10).cast("decimal(2,0)")) == 1


def first_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Keep the earliest row per key; ``order`` is a number or stamp unique to each row.

    The winners are joined back on that number, which is even whatever the keys look like.
    Rows without a number come last, in the order of their contents, so that no key is lost.
    """
    late = F.lit(Decimal(10**37)).cast("decimal(38,0)") + F.xxhash64(*df.columns).cast("decimal(20,0)")
    marked = df.withColumn("_orden", F.coalesce(order.cast("decimal(38,0)"), late.cast("decimal(38,0)")))
    firsts = marked.groupBy(F.col(key).alias("_k")).agg(F.min("_orden").alias("_o"))
    same = (F.col("_orden") == F.col("_o")) & F.col(key).eqNullSafe(F.col("_k"))
    return marked.join(firsts, same, "left_semi").drop("_orden")
