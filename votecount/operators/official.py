"""The binding count: row rules, normalised tables and lookups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import total_or_zero
from votecount.operators.groups import attach

ACCEPTED, SKIPPED, FAILED = "exitoso", "omitido", "error"


def _party_sum() -> Column:
    return F.col("p1") + F.col("p2") + F.col("p3") + F.col("p4")


def validate_official(
    rows: DataFrame, mesas: DataFrame, transcribed: DataFrame | None = None
) -> DataFrame:
    """Add ``motivo``: the first rule a submitted row breaks, NULL when it is accepted.

    Rows carry ``fila``, their order of arrival. Of several acceptable rows for one sheet
    the first is accepted. ``transcribed`` lists sheets accepted by earlier runs.
    """
    known = mesas.select("codigo_acta", F.col("votantes_habilitados").alias("_habilitados"))
    out = rows.join(known, "codigo_acta", "left")
    used = F.col("votos_validos") + F.col("votos_blancos") + F.col("votos_nulos")
    out = out.withColumn(
        "_regla",
        F.when(F.col("_habilitados").isNull(), K.RECHAZO_NO_ENCONTRADA)
        .when(_party_sum() != F.col("votos_validos"), K.RECHAZO_SUMA_PARTIDOS)
        .when(used != F.col("papeletas_anfora"), K.RECHAZO_ANFORA)
        .when(
            F.col("papeletas_anfora") + F.col("papeletas_no_utilizadas") != F.col("_habilitados"),
            K.RECHAZO_HABILITADOS,
        ),
    )
    sound = F.col("_regla").isNull()
    out = attach(out, "codigo_acta", {"_primera": F.min("fila")}, "fila", among=sound, min_rows=2)
    late = sound & (F.col("_primera") < F.col("fila"))
    if transcribed is not None:
        seen = transcribed.select("codigo_acta").distinct().withColumn("_ya", F.lit(True))
        out = out.join(seen, "codigo_acta", "left")
        late = late | (sound & F.coalesce("_ya", F.lit(False)))
    reason = F.when(F.coalesce(late, F.lit(False)), K.RECHAZO_YA_TRANSCRITA).otherwise(F.col("_regla"))
    return out.withColumn("motivo", reason).select(*rows.columns, "motivo")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("motivo").isNull()).drop("motivo")


def rejections(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("motivo").isNotNull())


def outcome_of(reason: Column) -> Column:
    """How the ingest robot counts a row: unknown and repeated sheets are skipped."""
    skipped = reason.isin(K.RECHAZO_NO_ENCONTRADA, K.RECHAZO_YA_TRANSCRITA)
    return F.when(reason.isNull(), ACCEPTED).when(skipped, SKIPPED).otherwise(FAILED)


def ingest_summary(validated: DataFrame) -> DataFrame:
    return (
        validated.groupBy(outcome_of(F.col("motivo")).alias("resultado"))
        .agg(F.count(F.lit(1)).alias("filas"))
        .orderBy("resultado")
    )


# Fields checked for negative counts, in the order the first offender is named.
_CHECKED = (
    ("P1", "p1"),
    ("P2", "p2"),
    ("P3", "p3"),
    ("P4", "p4"),
    ("VotosValidos", "votos_validos"),
    ("VotosBlancos", "votos_blancos"),
    ("VotosNulos", "votos_nulos"),
    ("PapeletasAnfora", "papeletas_anfora"),
    ("PapeltasNoUtilizadas", "papeletas_no_utilizadas"),
)


def prevalidate_rows(rows: DataFrame) -> DataFrame:
    """Add ``motivo`` of the check made before a row is submitted at all."""
    text = lambda c: c.cast("string")
    used = F.col("votos_validos") + F.col("votos_blancos") + F.col("votos_nulos")
    negative = [
        F.when(
            F.col(column) < 0,
            F.concat(F.lit(f'campo "{label}" es negativo ('), text(F.col(column)), F.lit(")")),
        )
        for label, column in _CHECKED
    ]
    reasons = negative + [
        F.when(
            _party_sum() != F.col("votos_validos"),
            F.concat(F.lit("P1+P2+P3+P4 ("), text(_party_sum()), F.lit(") ≠ VotosValidos ("),
                     text(F.col("votos_validos")), F.lit(")")),
        ),
        F.when(
            used != F.col("papeletas_anfora"),
            F.concat(F.lit("VotosValidos+Blancos+Nulos ("), text(used), F.lit(") ≠ PapeletasAnfora ("),
                     text(F.col("papeletas_anfora")), F.lit(")")),
        ),
    ]
    return rows.withColumn("motivo", F.coalesce(*reasons))


def to_official_tables(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows as one sheet row plus four vote rows each."""
    sheets = valid.drop("p1", "p2", "p3", "p4")
    return sheets, official_votes_long(valid)


def official_votes_long(rows: DataFrame) -> DataFrame:
    party = F.substring("_columna", 2, 1).cast("int")
    return rows.unpivot("codigo_acta", ["p1", "p2", "p3", "p4"], "_columna", "cantidad_votos").select(
        "codigo_acta", party.alias("id_partido"), "cantidad_votos"
    )


def pivot_votes(votes: DataFrame) -> DataFrame:
    """Long votes back to one row per sheet; parties other than 1 to 4 count nowhere."""
    one = lambda i: total_or_zero(
        F.when(F.col("id_partido") == i, F.col("cantidad_votos")).otherwise(0)
    )
    return votes.groupBy("codigo_acta").agg(*[one(i).alias(f"P{i}") for i in range(1, 5)])


def find_mesa(
    mesas: DataFrame,
    precincts: DataFrame,
    territory: DataFrame,
    transcribed: DataFrame,
    codigo_acta=None,
    codigo_recinto=None,
    nro_mesa=None,
) -> DataFrame:
    """Tables not transcribed yet, with their place; by sheet code, else place and number.

    With no argument all untranscribed tables are listed.
    """
    found = mesas
    if codigo_acta is not None:
        found = found.where(F.col("codigo_acta") == codigo_acta)
    elif codigo_recinto is not None and nro_mesa is not None:
        found = found.where(
            (F.col("codigo_recinto") == codigo_recinto) & (F.col("nro_mesa") == nro_mesa)
        ).orderBy("codigo_acta").limit(1)
    return (
        not_yet_transcribed(found, transcribed)
        .join(precincts.drop("provincia"), "codigo_recinto", "left")
        .join(territory, "codigo_territorial", "left")
        .select("codigo_acta", "recinto", "departamento", "municipio", "nro_mesa", "votantes_habilitados")
    )


def not_yet_transcribed(mesas: DataFrame, transcribed: DataFrame) -> DataFrame:
    return mesas.join(transcribed.select("codigo_acta"), "codigo_acta", "left_anti")


def already_transcribed(mesas: DataFrame, transcribed: DataFrame) -> DataFrame:
    return mesas.join(transcribed.select("codigo_acta"), "codigo_acta", "left_semi")
