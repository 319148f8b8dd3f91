"""Questions that are specified but that no counting system answered so far."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import numeric_code, pct, total_or_zero
from votecount.plans.replay import arrivals


def vote_mix(t: DataFrame) -> DataFrame:
    """Null, blank and candidate votes per department, and valid minus blank."""
    by_candidate = F.col("P1") + F.col("P2") + F.col("P3") + F.col("P4")
    return (
        t.groupBy("departamento")
        .agg(
            total_or_zero(F.col("votos_nulos")).alias("votos_nulos"),
            total_or_zero(F.col("votos_blancos")).alias("votos_blancos"),
            total_or_zero(by_candidate).alias("por_candidatos"),
            total_or_zero(F.col("votos_validos")).alias("votos_validos"),
        )
        .withColumn("validos_menos_blancos", F.col("votos_validos") - F.col("votos_blancos"))
        .orderBy("departamento")
    )


def active_precincts(sheets: DataFrame, mesas: DataFrame, precincts: DataFrame, territory: DataFrame) -> DataFrame:
    """Places that sent sheets and how many; counted per place before names are joined."""
    coded = sheets.select(numeric_code(F.col("acta_id")).alias("codigo_acta"))
    counts = (
        coded.join(mesas.select("codigo_acta", "codigo_recinto"), "codigo_acta")
        .groupBy("codigo_recinto")
        .agg(F.count(F.lit(1)).alias("actas"))
    )
    return (
        counts.join(precincts.select("codigo_recinto", "recinto", "codigo_territorial"), "codigo_recinto")
        .join(territory.select("codigo_territorial", "departamento"), "codigo_territorial")
        .select("codigo_recinto", "recinto", "departamento", "actas")
    )


def annulled_share(sheets: DataFrame, official: DataFrame) -> DataFrame:
    """Annulled share per department in both counts.

    The official count has no annulled state; its rejected rows (``motivo``) stand for it.
    """
    quick = sheets.groupBy("departamento").agg(
        F.count(F.lit(1)).alias("_qn"), F.count_if(F.col("estado") == K.ANULADA).alias("_qa")
    )
    binding = official.groupBy("departamento").agg(
        F.count(F.lit(1)).alias("_on"), F.count_if(F.col("motivo").isNotNull()).alias("_oa")
    )
    zero = F.lit(0).cast("bigint")
    n = lambda c: F.coalesce(c, zero)
    return quick.join(binding, "departamento", "full").select(
        "departamento",
        n("_qa").alias("anuladas_trep"),
        n("_oa").alias("anuladas_oficial"),
        pct(n("_qa"), n("_qn")).alias("pct_trep"),
        pct(n("_oa"), n("_on")).alias("pct_oficial"),
    )


def delays(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """Seconds between closing and reception of every sheet (``segundos``, below 0 if received before)."""
    hours = t.select("codigo_acta", F.col("cierre_hora").try_cast("int").alias("_h"))
    coded = sheets.select("departamento", "fecha_recepcion", numeric_code(F.col("acta_id")).alias("codigo_acta"))
    return coded.join(hours, "codigo_acta").withColumn(
        "segundos",
        F.unix_seconds("fecha_recepcion")
        - F.unix_seconds(F.date_trunc("day", "fecha_recepcion"))
        - F.col("_h") * 3600,
    )


def mean_delay(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """First and last arrival and mean minutes between closing and reception.

    Closing is the closing hour on the day of reception; sheets received before it are not
    delays and are left out of the mean.
    """
    late = F.when(F.col("segundos") >= 0, F.col("segundos"))
    return delays(sheets, t).groupBy("departamento").agg(
        F.min("fecha_recepcion").alias("primera_acta"),
        F.max("fecha_recepcion").alias("ultima_acta"),
        F.when(F.count(late) > 0, F.sum(late) / F.count(late) / 60).otherwise(0.0).alias("minutos_promedio"),
    )


_COMPARED = {
    "P1": "p1",
    "P2": "p2",
    "P3": "p3",
    "P4": "p4",
    "votos_validos": "votos_validos",
    "votos_blancos": "votos_blancos",
    "votos_nulos": "votos_nulos",
    "papeletas_anfora": "papeletas_anfora",
    "votantes_habilitados": "electores_habilitados",
}


def _field_diffs(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """Official minus quick for every field read on both sides, per sheet."""
    votes = {f"p{i}": F.coalesce(F.get("candidatos", i - 1)["votos"], F.lit(0)) for i in range(1, 5)}
    quick = sheets.select(
        "acta_id", "estado", numeric_code(F.col("acta_id")).alias("codigo_acta"),
        *[votes.get(q, F.col(q)).alias(f"_{q}") for q in _COMPARED.values()],
    )
    official = t.select("codigo_acta", *_COMPARED)
    joined = quick.join(official, "codigo_acta")
    return joined.select(
        "acta_id", "estado",
        *[(F.col(o) - F.col(f"_{q}")).alias(f"dif_{o.lower()}") for o, q in _COMPARED.items()],
    )


def sheet_diff(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """Sheets on which both counts differ in any field."""
    diffs = _field_diffs(sheets, t)
    fields = [c for c in diffs.columns if c.startswith("dif_")]
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f) != 0)
    return diffs.where(differs).drop("estado")


def reliability(sheets: DataFrame, t: DataFrame, official: DataFrame) -> DataFrame:
    """Share of sheets to be trusted, per count.

    Quick: processed without any field differing from the official one. Official: accepted
    by every row rule.
    """
    diffs = _field_diffs(sheets, t)
    same = F.col("estado") == K.PROCESADA
    for f in (c for c in diffs.columns if c.startswith("dif_")):
        same = same & (F.col(f) == 0)
    quick = diffs.agg(F.count_if(same).alias("buenas"), F.count(F.lit(1)).alias("actas"))
    binding = official.agg(F.count_if(F.col("motivo").isNull()).alias("buenas"), F.count(F.lit(1)).alias("actas"))
    return (
        quick.withColumn("fuente", F.lit("TREP"))
        .unionByName(binding.withColumn("fuente", F.lit("OFICIAL")))
        .select("fuente", "buenas", "actas", pct(F.col("buenas"), F.col("actas")).alias("pct_confianza"))
    )


def file_volume(files: DataFrame) -> DataFrame:
    """Files and megabytes per department; ``files`` has departamento and bytes."""
    return (
        files.groupBy("departamento")
        .agg(F.count(F.lit(1)).alias("archivos"), total_or_zero(F.col("bytes")).alias("bytes"))
        .withColumn("megabytes", F.col("bytes") / 1048576.0)
        .orderBy("departamento")
    )


def processing_rate(sheets: DataFrame, width: str = "1 day") -> DataFrame:
    """Sheets per window and per hour of window, with the processed share."""
    windows = sheets.groupBy(F.window("fecha_recepcion", width).alias("w")).agg(
        F.count(F.lit(1)).alias("recibidas"),
        F.count_if(F.col("estado") == K.PROCESADA).alias("procesadas"),
    )
    hours = (F.unix_seconds("w.end") - F.unix_seconds("w.start")) / 3600
    return windows.select(
        F.col("w.start").alias("inicio"), "recibidas", "procesadas",
        (F.col("recibidas") / hours).alias("por_hora"),
        pct(F.col("procesadas"), F.col("recibidas")).alias("pct_procesadas"),
    )


def turnout_basis(t: DataFrame) -> DataFrame:
    """Turnout of every table with voters, in whole hundredths of a percent."""
    return t.where(F.col("votantes_habilitados") > 0).select(
        "departamento", "codigo_acta",
        F.expr("papeletas_anfora * 10000 div votantes_habilitados").alias("centesimas"),
    )


def turnout_outliers(t: DataFrame, limit: float = 2.0) -> DataFrame:
    """Tables whose turnout is over ``limit`` standard deviations from their department's.

    Turnout is taken in whole hundredths of a percent so that the sums are exact. The
    department figures are aggregated first and joined back: a handful of rows, where a
    window would bring a whole department into one task.
    """
    basis = turnout_basis(t)
    c = F.col("centesimas")
    stats = basis.groupBy("departamento").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(c).alias("_s"),
        F.sum((c * c).cast("decimal(20,0)")).cast("double").alias("_q"),
    )
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    variance = F.when(n > 1, (q - s.cast("double") * s.cast("double") / n) / (n - 1))
    z = (c - s / n) / F.sqrt(variance)
    return (
        basis.join(stats, "departamento")
        .withColumn("z", F.when(variance > 0, F.round(z, 4)))
        .where(F.abs("z") > limit)
        .select("departamento", "codigo_acta", "centesimas", "z")
    )


def arrivals_per_minute(sheets: DataFrame, watermark: str | None = None) -> DataFrame:
    return arrivals(sheets, "fecha_recepcion", "1 minute", watermark)
