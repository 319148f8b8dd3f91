"""Indicators over time and outliers that hold against bad values.

Quantiles and distinct counts come twice: exactly, and as sketches that are kept per window and merged
to wider windows, so that a long history is never read again. No group is sorted or collected: medians
come from counts per value, and what is kept of a group is bounded by its distinct values.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.functions.scalars import numeric_code
from votecount.operators.groups import stamp
from votecount.plans.extensions import delays, turnout_basis

#: Size of a quantile sketch; its rank error is about 1.33 % at this size.
KLL_K = 200
#: Log2 of the registers of a distinct sketch; its standard error is about 1.6 % at this size.
HLL_K = 12
#: Value that a chi-square of nine degrees of freedom is over in one case of a hundred.
CHI_SQUARE_9 = 21.666


def state_as_of(events: DataFrame, times: list[datetime], tiebreak: str = "event_id") -> DataFrame:
    """The last event of every sheet at or before each of ``times``.

    An event counts for all times from its own on; the highest stamp per sheet and time is found by
    hash aggregation and its event joined back. Sheets without an event until then have no row, and
    events without a time count for none.
    """
    # As texts, so that they are read in the session's zone like the events' own times.
    asked = F.array(*[F.lit(str(t)).cast("timestamp") for t in sorted(set(times))])
    order = stamp(F.col("fecha"), F.col(tiebreak), missing=-(10**18 - 1)).alias("_orden")
    rows = events.where(F.col("fecha") <= F.lit(str(max(times))).cast("timestamp")).select("acta_id", "tipo_evento", "fecha", order)
    seen = rows.select("acta_id", "_orden", F.explode(F.filter(asked, lambda t: t >= F.col("fecha"))).alias("momento"))
    last = seen.groupBy("acta_id", "momento").agg(F.max("_orden").alias("_orden"), F.count(F.lit(1)).alias("eventos"))
    found = rows.withColumnRenamed("acta_id", "_acta").withColumnRenamed("_orden", "_o")
    met = last.join(found, F.col("acta_id").eqNullSafe(F.col("_acta")) & (F.col("_orden") == F.col("_o")))
    return met.select("acta_id", "momento", F.col("tipo_evento").alias("ultimo_evento"), "fecha", "eventos")


def _median(df: DataFrame, value: str, name: str) -> DataFrame:
    """Exact median per department from counts per value."""
    counts = df.groupBy("departamento", value).agg(F.sum("n").alias("n"))
    return counts.groupBy("departamento").agg(F.percentile(value, 0.5, F.col("n")).alias(name))


def turnout_outliers_robust(t: DataFrame, limit: float = 3.5) -> DataFrame:
    """Tables whose turnout is far from their department's median, in units of the median deviation.

    The score is 0.6745 * (value - median) / MAD; departments whose MAD is 0 have none.
    """
    basis = turnout_basis(t)
    counts = basis.groupBy("departamento", "centesimas").agg(F.count(F.lit(1)).alias("n"))
    medians = _median(counts, "centesimas", "mediana")
    away = counts.join(medians, "departamento").withColumn("_lejos", F.abs(F.col("centesimas") - F.col("mediana")))
    stats = medians.join(_median(away, "_lejos", "mad"), "departamento")
    score = F.lit(0.6745) * (F.col("centesimas") - F.col("mediana")) / F.col("mad")
    return (
        basis.join(stats, "departamento")
        .withColumn("puntaje", F.when(F.col("mad") > 0, F.round(score, 4)))
        .where(F.abs("puntaje") > limit)
        .select("departamento", "codigo_acta", "centesimas", "mediana", "mad", "puntaje")
    )


def digit_test(t: DataFrame, limit: float = CHI_SQUARE_9, least: int = 50) -> DataFrame:
    """Chi-square of the last digits of the candidates' votes per place against equal shares.

    Only places with ``least`` votes of two digits or more are judged, since last digits of small
    numbers are not spread evenly.
    """
    votes = [F.col(p) for p in ("P1", "P2", "P3", "P4")]
    met = lambda d: sum((F.when((v >= 10) & (v % 10 == d), 1).otherwise(0) for v in votes), F.lit(0))
    counts = t.groupBy("codigo_recinto").agg(*[F.sum(met(d)).alias(f"_{d}") for d in range(10)])
    n = sum((F.col(f"_{d}") for d in range(1, 10)), F.col("_0"))
    squares = sum((F.col(f"_{d}") * F.col(f"_{d}") for d in range(1, 10)), F.col("_0") * F.col("_0"))
    return (
        counts.select("codigo_recinto", n.alias("cifras"), squares.alias("_q"))
        .where(F.col("cifras") >= least)
        .withColumn("chi2", F.round((10 * F.col("_q") - F.col("cifras") * F.col("cifras")) / F.col("cifras"), 6))
        .select("codigo_recinto", "cifras", "chi2", (F.col("chi2") > limit).alias("sospechoso"))
    )


def _windows(when: str, width: str) -> Column:
    return F.window(when, width).alias("w")


def latency_exact(sheets: DataFrame, t: DataFrame, width: str = "1 hour") -> DataFrame:
    """Exact median and 95th percentile of seconds from closing to reception, per window of reception."""
    late = delays(sheets, t).where(F.col("segundos") >= 0)
    counts = late.groupBy(_windows("fecha_recepcion", width), "segundos").agg(F.count(F.lit(1)).alias("n"))
    quantile = lambda q: F.percentile("segundos", q, F.col("n"))
    return counts.groupBy("w").agg(F.sum("n").alias("actas"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95")).select(
        F.col("w.start").alias("inicio"), "actas", "p50", "p95"
    )


def latency_parts(sheets: DataFrame, t: DataFrame, width: str = "1 hour") -> DataFrame:
    """One quantile sketch of the seconds per window of reception: inicio, actas, parte."""
    late = delays(sheets, t).where(F.col("segundos") >= 0)
    return (
        late.groupBy(_windows("fecha_recepcion", width))
        .agg(
            F.count(F.lit(1)).alias("actas"),
            F.expr(f"kll_sketch_agg_bigint(CAST(segundos AS BIGINT), {KLL_K})").alias("parte"),
        )
        .select(F.col("w.start").alias("inicio"), "actas", "parte")
    )


def latency_of_parts(parts: DataFrame, width: str = "1 day") -> DataFrame:
    """Median and 95th percentile per wider window; ``parts`` may come from many runs."""
    merged = parts.groupBy(_windows("inicio", width)).agg(
        F.sum("actas").alias("actas"), F.expr("kll_merge_agg_bigint(parte)").alias("parte")
    )
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_bigint(parte, {q}D)")
    return merged.select(
        F.col("w.start").alias("inicio"), "actas", quantile(0.5).alias("p50"), quantile(0.95).alias("p95")
    )


def _placed(sheets: DataFrame, mesas: DataFrame) -> DataFrame:
    coded = sheets.select("fecha_recepcion", numeric_code(F.col("acta_id")).alias("codigo_acta"))
    return coded.join(mesas.select("codigo_acta", "codigo_recinto"), "codigo_acta")


def active_places(sheets: DataFrame, mesas: DataFrame, width: str = "1 hour") -> DataFrame:
    """Exact number of different places that sent sheets, per window; pairs are made distinct first."""
    pairs = _placed(sheets, mesas).select(_windows("fecha_recepcion", width), "codigo_recinto").distinct()
    return pairs.groupBy("w").agg(F.count("codigo_recinto").alias("recintos")).select(
        F.col("w.start").alias("inicio"), "recintos"
    )


def active_place_parts(
    sheets: DataFrame, mesas: DataFrame, width: str = "1 hour", watermark: str | None = None
) -> DataFrame:
    """One distinct sketch of the places per window; with a watermark also on a stream."""
    rows = sheets.withWatermark("fecha_recepcion", watermark) if watermark else sheets
    return (
        _placed(rows, mesas)
        .groupBy(_windows("fecha_recepcion", width))
        .agg(F.hll_sketch_agg(F.col("codigo_recinto").cast("bigint"), HLL_K).alias("parte"))
        .select(F.col("w.start").alias("inicio"), "parte")
    )


def active_places_of_parts(parts: DataFrame, width: str = "1 day") -> DataFrame:
    """Number of different places per wider window, from the merged sketches."""
    merged = parts.groupBy(_windows("inicio", width)).agg(F.hll_union_agg("parte").alias("parte"))
    return merged.select(F.col("w.start").alias("inicio"), F.hll_sketch_estimate("parte").alias("recintos"))
