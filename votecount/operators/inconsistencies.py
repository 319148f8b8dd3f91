"""The four inconsistency detectors.

Each detector is an array expression over one enriched row, so running all of them costs
one join against the reference and one explode, not four passes over the sheets.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import numeric_code, sum_votes, trim_all
from votecount.operators.validation import _msg, candidate_sum_off, counted_total, total_off

_ISSUE = "struct<tipo:string,descripcion:string,severidad:string,metadata:map<string,string>>"
OUTPUT = ["acta_id", "tipo", "descripcion", "severidad", "metadata", "fuente", "fecha"]


def _issue(kind: str, text: Column, severity: str, **meta: Column) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(kind).alias("tipo"),
        text.alias("descripcion"),
        F.lit(severity).alias("severidad"),
        F.create_map(*pairs).alias("metadata"),
    )


def _collect(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues)).cast(f"array<{_ISSUE}>")


def arithmetic() -> Column:
    total = sum_votes(F.col("candidatos"))
    valid, stated = F.col("votos_validos"), F.col("total_votos")
    return _collect(
        F.when(
            candidate_sum_off(),
            _issue(
                K.INCONSISTENCIA_ARITMETICA,
                _msg("Suma de votos por candidatos (", total, ") no coincide con votos válidos (", valid, ")"),
                K.CRITICA,
                suma_candidatos=total, votos_validos=valid, diferencia=total - valid,
            ),
        ),
        F.when(
            total_off(),
            _issue(
                K.INCONSISTENCIA_ARITMETICA,
                _msg("Total votos (", stated, ") ≠ válidos(", valid, ")+blancos(", F.col("votos_blancos"),
                     ")+nulos(", F.col("votos_nulos"), ")=", counted_total()),
                K.ALTA,
                total_reportado=stated, total_calculado=counted_total(),
            ),
        ),
    )


def contradictory() -> Column:
    reported, official = F.col("electores_habilitados"), F.col("ref_habilitados")
    total = F.col("total_votos")
    box, official_box = F.col("papeletas_anfora"), F.col("ref_anfora")
    printed = F.col("ref_habilitados").isNotNull()
    return _collect(
        F.when(
            (reported > 0) & (official > 0) & (reported != official),
            _issue(
                K.DATOS_CONTRADICTORIOS,
                _msg("Votantes habilitados reportados (", reported, ") ≠ registro oficial (", official, ")"),
                K.ALTA,
                reportado=reported, oficial=official, codigo_acta_ref=F.col("ref_codigo"),
            ),
        ),
        F.when(
            (official > 0) & (total > official),
            _issue(
                K.DATOS_CONTRADICTORIOS,
                _msg("Total votos (", total, ") supera votantes habilitados (", official, ")"),
                K.CRITICA,
                total_votos=total, votantes_habilitados=official,
            ),
        ),
        F.when(
            printed & (official_box > 0) & (box > 0) & (box != official_box),
            _issue(
                K.DATOS_CONTRADICTORIOS,
                _msg("Papeletas en ánfora reportadas (", box, ") ≠ transcripción oficial (", official_box, ")"),
                K.ALTA,
                reportado=box, oficial=official_box,
            ),
        ),
    )


def missing_times() -> Column:
    blank = lambda c: F.coalesce(trim_all(F.col(c).cast("string")), F.lit("")).isin("", "0")
    known = F.coalesce(F.col("ref_transcrita"), F.lit(False))
    return _collect(
        F.when(
            known & blank("ref_apertura"),
            _issue(
                K.FALTA_APERTURA_CIERRE,
                F.lit("Falta hora de apertura de la jornada electoral en el acta"),
                K.MEDIA,
                campo=F.lit("AperturaHora"),
            ),
        ),
        F.when(
            known & blank("ref_cierre"),
            _issue(
                K.FALTA_APERTURA_CIERRE,
                F.lit("Falta hora de cierre de la jornada electoral en el acta"),
                K.MEDIA,
                campo=F.lit("CierreHora"),
            ),
        ),
    )


def conflicting_duplicate() -> Column:
    """Difference to the stored sheet of the same id, given as struct ``previa``."""
    old = lambda n: F.col(f"previa.{n}")
    diff = lambda n: F.when(
        old(n) != F.col(n), _msg(f"{n}: anterior=", old(n), ", nuevo=", F.col(n))
    )
    department = F.when(
        (F.col("departamento") != "") & (old("departamento") != F.col("departamento")),
        _msg("departamento: anterior=", old("departamento"), ", nuevo=", F.col("departamento")),
    )
    diffs = F.array_compact(
        F.array(diff("votos_validos"), diff("votos_nulos"), diff("votos_blancos"), department)
    )
    return _collect(
        F.when(
            F.col("previa").isNotNull() & (F.size(diffs) > 0),
            _issue(
                K.DUPLICADO_DATOS_DIFERENTES,
                _msg("Acta recibida con anterioridad y datos no coinciden: ", F.array_join(diffs, "; ")),
                K.CRITICA,
                diferencias=F.array_join(diffs, "; "),
                hash_anterior=old("hash_origen"), hash_nuevo=F.col("hash_origen"),
            ),
        )
    )


def reference_frame(printed: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """Reference columns per numeric code: printed registry, left-joined transcription."""
    t = transcriptions.select(
        "codigo_acta",
        F.col("papeletas_anfora").alias("ref_anfora"),
        F.col("apertura_hora").alias("ref_apertura"),
        F.col("cierre_hora").alias("ref_cierre"),
        F.lit(True).alias("ref_transcrita"),
    )
    p = printed.select("codigo_acta", F.col("votantes_habilitados").alias("ref_habilitados"))
    return p.join(t, "codigo_acta", "full").withColumnRenamed("codigo_acta", "ref_codigo")


def reference_from_wide(transcriptions: DataFrame) -> DataFrame:
    """Same columns when the transcription row already carries the registered voters."""
    return transcriptions.select(
        F.col("codigo_acta").alias("ref_codigo"),
        F.col("votantes_habilitados").alias("ref_habilitados"),
        F.col("papeletas_anfora").alias("ref_anfora"),
        F.col("apertura_hora").alias("ref_apertura"),
        F.col("cierre_hora").alias("ref_cierre"),
        F.lit(True).alias("ref_transcrita"),
    )


def with_reference(sheets: DataFrame, reference: DataFrame) -> DataFrame:
    """Left join on the numeric code; code 0 means there is nothing to look up.

    Rows without a code are spread over the partitions instead of meeting in the one that
    NULL keys hash to. A code that very many sheets claim is left to the skew-join split.
    """
    code = F.nullif(numeric_code(F.col("acta_id")), F.lit(0).cast("bigint"))
    if "consulta_referencia" in sheets.columns:
        code = F.when(F.col("consulta_referencia"), code)
    spread = F.pmod(F.xxhash64("acta_id", "fecha_recepcion", "hash_origen"), F.lit(4096)) + 1
    coded = sheets.withColumn("_codigo", code).withColumn(
        "_salt", F.when(F.col("_codigo").isNull(), spread).otherwise(F.lit(0).cast("bigint"))
    )
    keyed = reference.withColumn("_ref_salt", F.lit(0).cast("bigint"))
    on = (F.col("_codigo") == F.col("ref_codigo")) & (F.col("_salt") == F.col("_ref_salt"))
    return coded.join(keyed, on, "left").drop("_codigo", "_salt", "_ref_salt")


def explode_issues(rows: DataFrame, *detectors: Column, source: str | None = None) -> DataFrame:
    """One row per issue of the given detectors.

    ``source`` names the channel; rows that carry a ``canal`` column use that instead.
    """
    channel = F.lit(source) if source is not None else F.col("canal")
    found = detectors[0] if len(detectors) == 1 else F.concat(*detectors)
    return (
        rows.withColumn("_issues", found)
        .where(F.size("_issues") > 0)
        .select("acta_id", F.explode("_issues").alias("_i"), channel.alias("fuente"),
                F.col("fecha_recepcion").alias("fecha"))
        .select("acta_id", "_i.*", "fuente", "fecha")
        .select(*OUTPUT)
    )


def arithmetic_issues(sheets: DataFrame, source: str) -> DataFrame:
    return explode_issues(sheets, arithmetic(), source=source)


def contradictory_data(sheets: DataFrame, reference: DataFrame, source: str) -> DataFrame:
    return explode_issues(with_reference(sheets, reference), contradictory(), source=source)


def missing_times_issues(sheets: DataFrame, reference: DataFrame, source: str) -> DataFrame:
    return explode_issues(with_reference(sheets, reference), missing_times(), source=source)


def conflicting_duplicates(sheets: DataFrame, source: str) -> DataFrame:
    """Sheets must carry ``previa``, the stored sheet of the same id or NULL."""
    return explode_issues(sheets, conflicting_duplicate(), source=source)


def detect_all(sheets: DataFrame, reference: DataFrame, source: str | None = None) -> DataFrame:
    """All four detectors over sheets that carry ``previa``."""
    return explode_issues(
        with_reference(sheets, reference),
        arithmetic(), contradictory(), missing_times(), conflicting_duplicate(),
        source=source,
    )
