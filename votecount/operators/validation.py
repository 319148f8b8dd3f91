"""Validation errors of a sheet and the state they lead to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import sum_votes


def _msg(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _visual(name: str) -> Column:
    return F.col(f"validacion_visual.{name}")


def _has_visual() -> Column:
    return F.col("validacion_visual").isNotNull()


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def too_many_votes() -> Column:
    return (F.col("electores_habilitados") > 0) & (F.col("total_votos") > F.col("electores_habilitados"))


def candidate_sum_off() -> Column:
    return (
        (F.col("votos_validos") > 0)
        & (F.size("candidatos") > 0)
        & (sum_votes(F.col("candidatos")) != F.col("votos_validos"))
    )


def counted_total() -> Column:
    return F.col("votos_validos") + F.col("votos_blancos") + F.col("votos_nulos")


def total_off() -> Column:
    return (F.col("total_votos") > 0) & (counted_total() != F.col("total_votos"))


def sheet_errors() -> Column:
    """Ordered error texts of one sheet; an empty array for a clean one."""
    required = [
        F.when(_empty(name), _msg(f"campo obligatorio: {name} vacío"))
        for name in ("acta_id", "departamento", "municipio", "mesa")
    ]
    negative = [
        F.when(F.col(name) < 0, _msg(f"{name} no puede ser negativo: ", F.col(name)))
        for name in ("votos_validos", "votos_nulos", "votos_blancos")
    ]
    no_candidates = F.when(
        F.coalesce(F.size("candidatos"), F.lit(0)) <= 0,
        F.lit("no se encontraron candidatos en el acta"),
    )
    candidate_negative = F.transform(
        F.filter(
            F.coalesce(
                F.col("candidatos"),
                F.array().cast("array<struct<candidato_id:string,votos:bigint>>"),
            ),
            lambda c: c["votos"] < 0,
        ),
        lambda c: _msg("candidato ", c["candidato_id"], " tiene votos negativos: ", c["votos"]),
    )
    sums = [
        F.when(
            candidate_sum_off(),
            _msg(
                "inconsistencia aritmética: suma_candidatos(", sum_votes(F.col("candidatos")),
                ") != votos_validos(", F.col("votos_validos"), ")",
            ),
        ),
        F.when(
            total_off(),
            _msg(
                "inconsistencia en total: validos(", F.col("votos_validos"), ") + blancos(",
                F.col("votos_blancos"), ") + nulos(", F.col("votos_nulos"), ") = ", counted_total(),
                ", pero total_votos = ", F.col("total_votos"),
            ),
        ),
    ]
    visual = [
        F.when(
            _visual("lapiz_detectado"),
            _msg(
                "NULIDAD — USO DE LÁPIZ: intensidad promedio ",
                F.format_string("%.1f", _visual("intensidad_promedio")), ", contraste ",
                F.format_string("%.3f", _visual("ratio_contraste")),
            ),
        ),
        F.when(_visual("corrector_detectado"), F.lit("NULIDAD — CORRECTOR (LIQUID PAPER) detectado")),
        F.when(_visual("tachadura_detectada"),
               F.lit("NULIDAD — TACHADURA: números superpuestos detectados")),
        F.when(_visual("texto_anulada_visual"),
               F.lit("NULIDAD — TEXTO 'ANULADA' escrito sobre el acta")),
        F.when(_visual("rotura_detectada"),
               F.lit("NULIDAD — ROTURA CRÍTICA: sección faltante del papel")),
        F.when(
            ~_visual("firmas_suficientes"),
            _msg("NULIDAD — FIRMAS INSUFICIENTES: ", _visual("huellas_detectadas"),
                 " huellas detectadas (mínimo 3)"),
        ),
        F.when(
            _visual("mancha_detectada"),
            _msg("OBSERVACIÓN — MANCHA sobre datos: ",
                 F.format_string("%.1f", _visual("porcentaje_mancha")), "% del área afectada"),
        ),
    ]
    too_many = F.when(
        too_many_votes(),
        _msg("NULIDAD — VOTOS > VOTANTES: total_votos(", F.col("total_votos"),
             ") > electores_habilitados(", F.col("electores_habilitados"), ")"),
    )
    return F.concat(
        F.array_compact(F.array(*required, *negative, no_candidates)),
        candidate_negative,
        F.array_compact(F.array(*sums, *visual, too_many)),
    )


def _annulment() -> Column:
    """Reason that annuls a sheet, in order of precedence, or NULL."""
    already = F.coalesce(F.col("estado") == K.ANULADA, F.lit(False))
    return (
        F.when(already, K.TEXTO_ANULADA)
        .when(_visual("texto_anulada_visual"), K.TEXTO_ANULADA_VISUAL)
        .when(_visual("lapiz_detectado"), K.USO_DE_LAPIZ)
        .when(_visual("corrector_detectado"), K.USO_DE_CORRECTOR)
        .when(_visual("tachadura_detectada"), K.TACHADURA_NUMEROS)
        .when(_visual("rotura_detectada"), K.ROTURA_CRITICA)
        .when(_has_visual() & ~_visual("firmas_suficientes"), K.FALTA_FIRMAS_HUELLAS)
        .when(too_many_votes(), K.VOTOS_MAYOR_QUE_VOTANTES)
    )


def decide_state(df: DataFrame, errors: str = "errores") -> DataFrame:
    """Set ``estado`` and ``motivo_estado`` from the errors and the visual flags.

    The incoming state only matters when the parser already found the sheet annulled.
    """
    out = df if "estado" in df.columns else df.withColumn("estado", F.lit(None).cast("string"))
    if "motivo_estado" not in out.columns:
        out = out.withColumn("motivo_estado", F.lit(""))
    out = out.withColumn("_anulacion", _annulment())
    has_errors = F.size(errors) > 0
    only_notes = F.forall(errors, lambda e: F.startswith(e, F.lit("OBSERVACIÓN")))
    stained = F.coalesce(_visual("mancha_detectada"), F.lit(False))
    state = (
        F.when(F.col("_anulacion").isNotNull(), K.ANULADA)
        .when(has_errors & only_notes, K.OBSERVADA)
        .when(has_errors, K.ERROR)
        .otherwise(K.PROCESADA)
    )
    out = out.withColumn("estado", state)
    reason = F.coalesce(
        F.col("_anulacion"),
        F.when((F.col("estado") == K.OBSERVADA) & stained, K.MANCHA_SOBRE_DATOS),
        F.lit(""),
    )
    return out.withColumn("motivo_estado", reason).drop("_anulacion")


def validate_sheets(df: DataFrame, keep_parser_errors: bool = False) -> DataFrame:
    """Errors and state of every sheet.

    ``keep_parser_errors`` puts the errors found while reading the text in front, as the
    folder job does; single uploads drop them.
    """
    found = sheet_errors()
    if keep_parser_errors:
        found = F.concat(F.col("errores_texto"), found)
    return decide_state(df.withColumn("errores", found))
