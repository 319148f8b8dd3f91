"""The statistics snapshot: one pass over the sheets, in long and in wide form.

The long form (grupo, clave, cantidad) replaces maps: a free-text department can take any
number of values, and rows scale where a map in one row does not. Every sheet contributes
its few entries, which combine partially before a single shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import ratio_2dec, total_or_zero


def _entry(group: str, key: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(group).alias("grupo"), key.alias("clave"), amount.cast("bigint").alias("cantidad")
    )


def breakdown(sheets: DataFrame) -> DataFrame:
    """Counts per state, department and channel; votes per kind and candidate (processed only)."""
    one = F.lit(1)
    good = F.col("estado") == K.PROCESADA
    named = lambda group, column: F.when(
        F.coalesce(F.col(column), F.lit("")) != "", _entry(group, F.col(column), one)
    )
    votes = [
        F.when(good, _entry("votos", F.lit(c), F.col(c)))
        for c in ("votos_validos", "votos_nulos", "votos_blancos")
    ]
    candidates = F.when(
        good, F.transform("candidatos", lambda c: _entry("candidato", c["candidato_id"], c["votos"]))
    ).otherwise(F.array().cast("array<struct<grupo:string,clave:string,cantidad:bigint>>"))
    entries = F.concat(
        F.array_compact(
            F.array(
                named("estado", "estado"), named("departamento", "departamento"),
                named("tipo_entrada", "tipo_entrada"), *votes,
            )
        ),
        candidates,
    )
    return (
        sheets.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.grupo").alias("grupo"), F.col("e.clave").alias("clave"))
        .agg(total_or_zero(F.col("e.cantidad")).alias("cantidad"))
    )


def inconsistency_breakdown(inconsistencies: DataFrame) -> DataFrame:
    return (
        inconsistencies.groupBy(F.coalesce("tipo", F.lit("")).alias("clave"))
        .agg(F.count(F.lit(1)).alias("cantidad"))
        .select(F.lit("inconsistencia").alias("grupo"), "clave", "cantidad")
    )


def long_snapshot(sheets: DataFrame, inconsistencies: DataFrame) -> DataFrame:
    return breakdown(sheets).unionByName(inconsistency_breakdown(inconsistencies))


def signed_breakdown(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed sheets add to the counts: their old version counts off, the new one on.

    Added to earlier counts this gives those of the changed sheets; groups without a change are left out.
    """
    off = breakdown(before).withColumn("cantidad", -F.col("cantidad"))
    change = breakdown(after).unionByName(off).groupBy("grupo", "clave").agg(F.sum("cantidad").alias("cantidad"))
    return change.where("cantidad <> 0")


def victory_margin(candidate_totals: DataFrame, valid: DataFrame) -> DataFrame:
    """Gap between the two best candidates in percent of the valid votes, two decimals.

    ``candidate_totals`` has one row per candidate (votos); ``valid`` one row (votos_validos).
    """
    best = candidate_totals.orderBy(F.desc("votos")).limit(2).agg(
        F.max("votos").alias("_uno"), F.min("votos").alias("_dos"), F.count(F.lit(1)).alias("_n")
    )
    return best.crossJoin(valid.select("votos_validos")).select(margin().alias("margen_victoria"))


def margin() -> Column:
    gap = (F.col("_uno") - F.col("_dos")) / F.col("votos_validos") * 100
    counted = (F.col("votos_validos") != 0) & (F.col("_n") >= 2)
    return F.when(counted, F.round(gap * 100) / 100).otherwise(F.lit(0.0))


def project_snapshot(sheets: DataFrame, printed: DataFrame, inconsistencies: DataFrame) -> DataFrame:
    """One row of headline figures."""
    return project_parts(long_snapshot(sheets, inconsistencies), printed)


def project_parts(parts: DataFrame, printed: DataFrame) -> DataFrame:
    """Headline figures from counts that add up (``long_snapshot``, of one or of many batches)."""
    pick = lambda group, key: total_or_zero(
        F.when((F.col("grupo") == group) & (F.col("clave") == key), F.col("cantidad"))
    )
    scalars = parts.agg(
        pick("estado", K.PROCESADA).alias("total_actas_procesadas"),
        pick("estado", K.ERROR).alias("total_actas_error"),
        pick("estado", K.ANULADA).alias("total_actas_anuladas"),
        pick("estado", K.OBSERVADA).alias("total_actas_observadas"),
        *[
            pick("votos", c).alias(f"total_{c}")
            for c in ("votos_validos", "votos_nulos", "votos_blancos")
        ],
        total_or_zero(F.when(F.col("grupo") == "inconsistencia", F.col("cantidad"))).alias("total_inconsistencias"),
    )
    # Ordered by an expression, not filtered: a filter would be pushed below the grouping
    # and the grouping would then run twice instead of its shuffle being shared.
    candidate = F.when(F.col("grupo") == "candidato", F.col("cantidad"))
    best = (
        parts.orderBy(candidate.desc_nulls_last(), "clave")
        .limit(2)
        .agg(F.max(candidate).alias("_uno"), F.min(candidate).alias("_dos"), F.count(candidate).alias("_n"))
    )
    expected = printed.agg(
        F.count(F.lit(1)).alias("total_actas_esperadas"),
        total_or_zero(F.col("votantes_habilitados")).alias("total_habilitados"),
    )
    voters = F.col("total_votos_validos") + F.col("total_votos_nulos") + F.col("total_votos_blancos")
    seen = (
        F.col("total_actas_procesadas") + F.col("total_actas_error")
        + F.col("total_actas_anuladas") + F.col("total_actas_observadas")
    )
    row = scalars.crossJoin(best).crossJoin(expected)
    row = row.withColumn("votos_validos", F.col("total_votos_validos")).withColumns(
        {
            "total_votantes": voters,
            "porcentaje_avance": ratio_2dec(seen, F.col("total_actas_esperadas")),
            "tasa_participacion": ratio_2dec(voters, F.col("total_habilitados")),
            "margen_victoria": margin(),
        }
    )
    return row.drop("_uno", "_dos", "_n", "votos_validos")


def full_stats(snapshot: DataFrame, precincts: DataFrame) -> DataFrame:
    """Snapshot with the sheets still missing, the number of places and the published share."""
    seen = (
        F.col("total_actas_procesadas") + F.col("total_actas_error")
        + F.col("total_actas_anuladas") + F.col("total_actas_observadas")
    )
    places = precincts.agg(F.count(F.lit(1)).alias("total_recintos"))
    return (
        snapshot.crossJoin(places)
        .withColumn("total_actas_pendientes", F.col("total_actas_esperadas") - seen)
        .withColumn("porcentaje_publicadas", F.col("porcentaje_avance"))
    )


def basic_stats(sheets: DataFrame) -> DataFrame:
    """The small statistics bundle in long form, with the number of sheets on top."""
    return breakdown(sheets).where(
        (F.col("grupo") != "estado") | F.col("clave").isin(K.PROCESADA, K.ERROR)
    ).unionByName(
        sheets.agg(F.count(F.lit(1)).alias("cantidad")).select(
            F.lit("total").alias("grupo"), F.lit("actas").alias("clave"), "cantidad"
        )
    )
