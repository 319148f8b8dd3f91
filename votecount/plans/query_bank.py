"""The question bank over transcriptions and quick-count sheets.

Transcriptions are wide rows: departamento, provincia, municipio, recinto, codigo_recinto,
codigo_acta, nro_mesa, votantes_habilitados, papeletas_anfora, P1..P4, votos_*.
All groupings combine partially before their one shuffle, so a department holding a third
of all rows costs no task more than the others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import positive_pct, total_or_zero


def _all_parties() -> Column:
    """Sum over the parties; NULL if any is NULL, so that such a row adds nothing."""
    return F.col("P1") + F.col("P2") + F.col("P3") + F.col("P4")


def _per_department(t: DataFrame, **sums) -> DataFrame:
    return t.groupBy("departamento").agg(*[total_or_zero(c).alias(n) for n, c in sums.items()])


def mesas_per_precinct(t: DataFrame) -> DataFrame:
    return (
        t.groupBy("departamento", "recinto")
        .agg(F.count(F.lit(1)).alias("cantidad_mesas"))
        .orderBy("departamento", F.desc("cantidad_mesas"), "recinto")
    )


def votes_by_municipality(t: DataFrame) -> DataFrame:
    return (
        t.groupBy("departamento", "municipio")
        .agg(total_or_zero(_all_parties()).alias("total_votos"))
        .orderBy("departamento", F.desc("total_votos"), "municipio")
    )


def votes_by_department(t: DataFrame) -> DataFrame:
    return _per_department(t, total_votos=_all_parties()).orderBy(F.desc("total_votos"), "departamento")


def top_precincts(t: DataFrame, candidate: str, n: int = K.TOP_PRECINCTS) -> DataFrame:
    """Places with most votes for a candidate; places of the same name count as one."""
    if candidate not in K.PARTY_COLUMNS:
        raise ValueError(f"candidate must be one of {K.PARTY_COLUMNS}")
    return (
        t.groupBy("recinto")
        .agg(total_or_zero(F.col(candidate)).alias("votos"))
        .select("recinto", "votos", F.lit(candidate).alias("candidato"))
        .orderBy(F.desc("votos"), "recinto")
        .limit(n if n > 0 else K.TOP_PRECINCTS)
    )


def null_votes_by_department(t: DataFrame) -> DataFrame:
    return (
        _per_department(t, votos_nulos=F.col("votos_nulos"), votos_validos=F.col("votos_validos"))
        .withColumn("porcentaje_nulos", positive_pct(F.col("votos_nulos"), F.col("votos_validos")))
        .orderBy(F.desc("votos_nulos"), "departamento")
    )


def high_abstention(t: DataFrame, threshold: float = K.ABSTENTION_THRESHOLD) -> DataFrame:
    """Tables whose abstention is strictly above the threshold, highest first."""
    limit = threshold if threshold > 0 else K.ABSTENTION_THRESHOLD
    registered, cast = F.col("votantes_habilitados"), F.col("papeletas_anfora")
    return (
        t.select(
            "departamento", "recinto", "nro_mesa", "codigo_acta", "votantes_habilitados",
            cast.alias("votos_emitidos"),
            F.when(registered > 0, (registered - cast) / registered * 100).otherwise(0.0).alias("abstencion_pct"),
        )
        .where(F.col("abstencion_pct") > limit)
        .orderBy(F.desc("abstencion_pct"), "codigo_acta")
    )


def turnout_by_department(t: DataFrame) -> DataFrame:
    return (
        _per_department(
            t, votantes_habilitados=F.col("votantes_habilitados"), votos_emitidos=F.col("papeletas_anfora")
        )
        .withColumn("participacion_pct", positive_pct(F.col("votos_emitidos"), F.col("votantes_habilitados")))
        .orderBy(F.desc("participacion_pct"), "departamento")
    )


def geo_results(
    t: DataFrame,
    department: str | None = None,
    municipality: str | None = None,
    province: str | None = None,
) -> DataFrame:
    """Candidate totals one level below the given one; a province wins over the others."""
    level = "departamento"
    rows = t
    if province:
        rows, level = t.where(F.col("provincia") == province), "provincia"
    elif municipality:
        rows, level = t.where(F.col("municipio") == municipality), "recinto"
    elif department:
        rows, level = t.where(F.col("departamento") == department), "municipio"
    return (
        rows.groupBy(F.col(level).alias("geo"))
        .agg(
            *[total_or_zero(F.col(p)).alias(p) for p in K.PARTY_COLUMNS],
            total_or_zero(_all_parties()).alias("total_votos"),
        )
        .orderBy(F.desc("total_votos"), "geo")
    )


def official_totals(t: DataFrame) -> DataFrame:
    return t.agg(
        *[total_or_zero(F.col(p)).alias(p) for p in K.PARTY_COLUMNS],
        *[total_or_zero(F.col(c)).alias(c) for c in ("votos_validos", "votos_nulos", "votos_blancos")],
    ).withColumn("total_votos", F.col("votos_validos") + F.col("votos_nulos") + F.col("votos_blancos"))


def department_votes(t: DataFrame) -> DataFrame:
    """Department roll-up with the candidates named; rows without a department are dropped."""
    return (
        t.where(F.col("departamento").isNotNull() & (F.col("departamento") != ""))
        .groupBy("departamento")
        .agg(
            *[total_or_zero(F.col(p)).alias(p) for p in K.PARTY_COLUMNS],
            total_or_zero(F.col("votos_validos")).alias("total_votos_validos"),
            total_or_zero(F.col("votos_nulos")).alias("total_votos_nulos"),
            total_or_zero(F.col("votos_blancos")).alias("total_votos_blancos"),
        )
        .withColumns({f"candidato_{p}": F.lit(n) for p, n in K.CANDIDATE_NAMES.items()})
        .orderBy("departamento")
    )


def reference_totals(printed: DataFrame, precincts: DataFrame, territory: DataFrame) -> DataFrame:
    """Expected sheets, places, registered voters and the departments of the territory."""
    sheets = printed.agg(
        F.count(F.lit(1)).alias("total_actas_esperadas"),
        total_or_zero(F.col("votantes_habilitados")).alias("total_votantes_habilitados"),
    )
    places = precincts.agg(F.count(F.lit(1)).alias("total_recintos"))
    departments = territory.agg(
        F.array_join(F.array_sort(F.collect_set("departamento")), ", ").alias("departamentos"),
        F.count_distinct("departamento").alias("total_departamentos"),
    )
    return sheets.crossJoin(places).crossJoin(departments)


# --- quick count ---------------------------------------------------------------


def sheets_per_hour(sheets: DataFrame) -> DataFrame:
    return (
        sheets.groupBy(F.hour("fecha_recepcion").alias("hora"))
        .agg(F.count(F.lit(1)).alias("actas_recibidas"))
        .orderBy("hora")
    )


def arrival_span(sheets: DataFrame) -> DataFrame:
    """First and last sheet of each department and the minutes between them."""
    span = F.unix_millis("ultima_acta") - F.unix_millis("primera_acta")
    return (
        sheets.groupBy("departamento")
        .agg(F.min("fecha_recepcion").alias("primera_acta"), F.max("fecha_recepcion").alias("ultima_acta"))
        .withColumn("tiempo_promedio_min", span / F.lit(60000.0))
        .orderBy("departamento")
    )


def vote_totals(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("estado") == K.PROCESADA).agg(
        *[total_or_zero(F.col(c)).alias(c) for c in ("votos_validos", "votos_nulos", "votos_blancos")]
    )


def votes_per_candidate(sheets: DataFrame) -> DataFrame:
    return (
        sheets.where(F.col("estado") == K.PROCESADA)
        .select(F.explode("candidatos").alias("c"))
        .groupBy(F.col("c.candidato_id").alias("candidato_id"))
        .agg(total_or_zero(F.col("c.votos")).alias("votos"))
        .orderBy(F.desc("votos"), "candidato_id")
    )


def quick_vs_official(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """Quick totals, official totals and quick minus official, one row per measure.

    Candidates are aligned by ordinal: C1 against P1 and so on, for as many as there are on
    either side.
    """
    good = sheets.where(F.col("estado") == K.PROCESADA)
    quick = good.agg(
        *[total_or_zero(F.col(c)).alias(f"q_{c}") for c in ("votos_validos", "votos_nulos", "votos_blancos")]
    )
    official = official_totals(t)
    measures = [
        ("totales", "q_votos_validos + q_votos_nulos + q_votos_blancos", "total_votos"),
        ("votos_validos", "q_votos_validos", "votos_validos"),
        ("votos_nulos", "q_votos_nulos", "votos_nulos"),
        ("votos_blancos", "q_votos_blancos", "votos_blancos"),
    ]
    rows = ", ".join(f"'{n}', {q}, {o}" for n, q, o in measures)
    totals = quick.crossJoin(official).selectExpr(f"stack({len(measures)}, {rows}) as (medida, trep, oficial)")
    trep = (
        good.select(F.posexplode("candidatos").alias("i", "c"))
        .groupBy((F.col("i") + 1).alias("i"))
        .agg(total_or_zero(F.col("c.votos")).alias("trep"))
    )
    parties = ", ".join(f"{i}, P{i}" for i in range(1, 5))
    both = trep.join(official.selectExpr(f"stack(4, {parties}) as (i, oficial)"), "i", "full")
    zero = F.lit(0).cast("bigint")
    candidates = both.select(
        F.concat(F.lit("P"), F.col("i").cast("string")).alias("medida"),
        F.coalesce("trep", zero).alias("trep"),
        F.coalesce("oficial", zero).alias("oficial"),
    )
    return totals.unionByName(candidates).withColumn("diferencia", F.col("trep") - F.col("oficial"))


def department_gap(sheets: DataFrame, t: DataFrame) -> DataFrame:
    """Quick against official valid votes per department of the quick count."""
    quick = sheets.groupBy("departamento").agg(
        F.count(F.lit(1)).alias("trep_actas"),
        total_or_zero(F.col("votos_validos")).alias("trep_votos_validos"),
    )
    official = votes_by_department(t).withColumnRenamed("total_votos", "oficial_votos_validos")
    zero = F.lit(0).cast("bigint")
    return (
        quick.join(official, "departamento", "left")
        .withColumn("oficial_votos_validos", F.coalesce("oficial_votos_validos", zero))
        .withColumn("diferencia_votos", F.col("trep_votos_validos") - F.col("oficial_votos_validos"))
        .withColumn("tiene_inconsistencia", F.col("diferencia_votos") != 0)
    )


def common_errors(inconsistencies: DataFrame) -> DataFrame:
    return (
        inconsistencies.where(F.col("tipo").isNotNull() & (F.col("tipo") != ""))
        .groupBy(F.col("tipo").alias("tipo_error"))
        .agg(F.count(F.lit(1)).alias("frecuencia"))
        .orderBy(F.desc("frecuencia"), "tipo_error")
    )
