"""Audit events of messages and files, derived from their outcomes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions import sms
from votecount.functions.scalars import join_first
from votecount.operators import machine as m


def _event(step: int, kind: str, sheet_id: Column) -> Column:
    return F.struct(
        F.lit(step).alias("paso"), F.lit(kind).alias("tipo_evento"), sheet_id.alias("acta_id")
    )


def _explode(rows: DataFrame, events: list[Column], meta: Column) -> DataFrame:
    kept = F.array_compact(F.array(*events))
    return (
        rows.select("seq", F.col("fecha_recepcion").alias("fecha"), meta.alias("metadata"),
                    F.explode(kept).alias("_e"))
        .select("seq", "_e.paso", "_e.acta_id", "_e.tipo_evento", "metadata", "fecha")
    )


def sms_events(outcomes: DataFrame) -> DataFrame:
    """Events of every message in order of ``paso``.

    The received event has no sheet id yet; the message hash in the metadata links it.
    """
    stage, sheet = F.col("etapa"), F.col("acta_id")
    format_ok = ~sms.malformed()
    earlier_id = F.coalesce(
        "acta_registrada", F.when(F.col("previo_autorizado") & format_ok, sheet).otherwise("")
    )
    kept = F.col("estado_sms") == K.SMS_PROCESADO
    events = [
        _event(1, K.SMS_RECIBIDO, F.lit("PENDIENTE")),
        F.when(stage == m.BY_PHONE, _event(2, K.SMS_TELEFONO_NO_AUTORIZADO, F.lit("RECHAZADO")))
        .when(stage == m.BY_HASH, _event(2, K.SMS_DUPLICADO, earlier_id))
        .when(stage == m.BY_PIN, _event(2, K.SMS_PIN_INVALIDO, sheet)),
        F.when(F.size("inconsistencias") > 0, _event(3, K.INCONSISTENCIAS_DETECTADAS, sheet)),
        F.when((stage == m.AS_SHEET) & ~kept, _event(4, K.DUPLICADO_DETECTADO, sheet))
        .when(kept, _event(4, K.ACTA_GUARDADA, sheet)),
    ]
    meta = F.create_map(F.lit("telefono"), "telefono", F.lit("hash"), "hash_mensaje")
    return _explode(outcomes, events, meta)


def upload_events(outcomes: DataFrame) -> DataFrame:
    """Events of every uploaded file in order of ``paso``."""
    sheet, result = F.col("acta_id"), F.col("resultado")
    fresh = result != m.SAME_FILE
    clean = F.size("errores") == 0
    events = [
        _event(1, K.ACTA_RECIBIDA, F.lit("PENDIENTE")),
        F.when(~fresh, _event(2, K.DUPLICADO_DETECTADO, F.coalesce("previa.acta_id", sheet))),
        F.when(fresh, _event(2, K.OCR_PROCESADO, sheet)),
        F.when(fresh & clean, _event(3, K.VALIDACION_OK, sheet)).when(
            fresh & ~clean, _event(3, K.VALIDACION_ERROR, sheet)
        ),
        F.when(fresh & (F.size("inconsistencias") > 0),
               _event(4, K.INCONSISTENCIAS_DETECTADAS, sheet)),
        F.when(result == m.SAME_SHEET, _event(5, K.DUPLICADO_DETECTADO, sheet))
        .when(result == m.STORED, _event(5, K.ACTA_GUARDADA, sheet)),
    ]
    meta = F.create_map(F.lit("filename"), "file_name", F.lit("hash"), "hash_origen")
    return _explode(outcomes, events, meta)


def unreadable_file_events(files: DataFrame) -> DataFrame:
    """Events of files no text could be extracted from: received, then a reading error."""
    events = [
        _event(1, K.ACTA_RECIBIDA, F.lit("PENDIENTE")),
        _event(2, K.OCR_PROCESADO, F.lit("ERROR_OCR")),
    ]
    meta = F.create_map(F.lit("filename"), "file_name", F.lit("hash"), "hash_origen")
    return _explode(files, events, meta)


# Texts of the confirmations, by state.
_CONFIRMATIONS = {
    K.PROCESADA: ("✅ Sistema RRV Bolivia: Acta ", " recibida y procesada correctamente."),
    K.ERROR: ("⚠️ Sistema RRV Bolivia: Acta ", " recibida con errores de validación. Será revisada."),
    K.ANULADA: ("❌ Sistema RRV Bolivia: Acta ", " marcada como ANULADA. Contacte al tribunal."),
}
_OTHER = ("📋 Sistema RRV Bolivia: Acta ", " recibida. Estado: ")
_FORMAT_ERROR = (
    "❌ Sistema RRV Bolivia: Error en formato de SMS. ",
    ". Formato: ACTA:MESA-ID|DEP:Dept|MUN:Mun|MESA:N|VAL:N|NUL:N|BLA:N|C1:N|C2:N|PIN:1234",
)


def confirmation_text(sheet: Column, state: Column) -> Column:
    text = F.concat(F.lit(_OTHER[0]), sheet, F.lit(_OTHER[1]), state)
    for known, (before, after) in _CONFIRMATIONS.items():
        text = F.when(state == known, F.concat(F.lit(before), sheet, F.lit(after))).otherwise(text)
    return text


def format_error_text(errors: Column) -> Column:
    """Explanation of a malformed message, cut to the gateway's 1600 bytes."""
    text = F.concat(F.lit(_FORMAT_ERROR[0]), F.array_join(errors, "; "), F.lit(_FORMAT_ERROR[1]))
    head = F.substring(text.cast("binary"), 1, K.SMS_TEXT_LIMIT - 3).cast("string")
    shortened = F.concat(F.make_valid_utf8(head), F.lit("..."))
    return F.when(F.octet_length(text) > K.SMS_TEXT_LIMIT, shortened).otherwise(text)


def notification_outbox(outcomes: DataFrame) -> DataFrame:
    """Texts to send back: one per stored sheet and one per malformed message."""
    kept = F.col("estado_sms") == K.SMS_PROCESADO
    malformed = F.col("etapa") == m.BY_FORMAT
    text = F.when(kept, confirmation_text(F.col("acta_id"), F.col("estado"))).otherwise(
        # An error has more than one byte, so these are all that can show in the text.
        format_error_text(sms.first_errors(K.SMS_TEXT_LIMIT))
    )
    return outcomes.where(kept | malformed).select(
        "seq", F.col("telefono").alias("destinatario"), text.alias("mensaje"),
        F.when(malformed, join_first(sms.first_errors(2), 2, sms.error_count())).otherwise("").alias("resumen"),
    )
