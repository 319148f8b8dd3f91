"""Decisions over arriving messages and files, as set-based plans.

The order in which one message at a time would be judged shows only in who came first for
a given text and for a given sheet id. Both are per-key facts of the whole set, so one plan
judges any number of messages, and a stream runs the same plan per micro-batch against what
is already stored.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.sms import authorised, malformed, parse_sms, sms_hash, sms_to_sheet
from votecount.operators import inconsistencies as inc
from votecount.functions.steps import once
from votecount.operators.groups import attach, stamp, stamp_bit, stamp_seq
from votecount.operators.lineage import cut, kept
from votecount.operators.validation import validate_sheets


@dataclass(frozen=True)
class SmsPolicy:
    """Who may report by text message, and the PIN that proves it."""

    phones: tuple[str, ...] = field(default_factory=tuple)
    pin: str = ""


# How far a message got; the last stage is the only one that yields a sheet.
BY_PHONE, BY_HASH, BY_FORMAT, BY_PIN, AS_SHEET = "TELEFONO", "HASH", "FORMATO", "PIN", "ACTA"

_PREVIOUS = ("votos_validos", "votos_nulos", "votos_blancos", "departamento", "hash_origen")


def hashed(messages: DataFrame, policy: SmsPolicy) -> DataFrame:
    return once(messages, {"hash_mensaje": sms_hash(F.col("mensaje_raw"))}).withColumn(
        "autorizado", authorised(F.col("telefono"), policy.phones)
    )


def mark_duplicate_hash(
    messages: DataFrame, registered: DataFrame | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Add ``es_primero`` and ``previo``: the first message with the same text, if another.

    Every earlier copy counts, also one that was refused. ``registered`` holds hashes (with
    the sheet id noted for them) that were stored before this set; ``source`` the same
    messages before they were parsed.
    """
    arrival = stamp(F.col("fecha_recepcion"), F.col("seq"), F.col("autorizado"))
    out = attach(messages, "hash_mensaje", {"_primero": F.min(arrival)}, "seq", min_rows=2, source=source)
    first = F.col("_primero")
    earlier = first.isNotNull() & (stamp_seq(first) != F.col("seq"))
    out = out.withColumn("previo_autorizado", F.when(earlier, stamp_bit(first)))
    if registered is None:
        out = out.withColumn("acta_registrada", F.lit(None).cast("string"))
    else:
        known = registered.select("hash_mensaje", F.col("acta_id").alias("acta_registrada"))
        out = out.join(known, "hash_mensaje", "left")
    alone = ~earlier & F.col("acta_registrada").isNull()
    return out.withColumn("es_primero", alone).drop("_primero")


def sms_outcomes(
    messages: DataFrame,
    policy: SmsPolicy,
    reference: DataFrame | None = None,
    registered: DataFrame | None = None,
    stored: DataFrame | None = None,
    copies: list[str] | None = None,
) -> DataFrame:
    """Every message with its stage, register state, sheet, and inconsistencies.

    ``registered`` / ``stored`` are the register and the sheets kept by earlier runs.
    """
    # Parsed once; the facts per text and per sheet id and the result read this copy.
    out = mark_duplicate_hash(kept(parse_sms(hashed(messages, policy)), copies), registered)
    out = out.withColumn(
        "etapa",
        F.when(~F.col("autorizado"), BY_PHONE)
        .when(~F.col("es_primero"), BY_HASH)
        .when(malformed(), BY_FORMAT)
        .when(F.col("sms_pin") != policy.pin, BY_PIN)
        .otherwise(AS_SHEET),
    )
    out = sms_to_sheet(out).withColumn(
        "validacion_visual", F.lit(None).cast("struct<%s>" % _visual_ddl())
    )
    out = validate_sheets(out)
    is_sheet = F.col("etapa") == AS_SHEET
    order = F.struct("fecha_recepcion", "seq")
    facts = {"_previa": F.min_by(F.struct("seq", *_PREVIOUS), order)}
    out = attach(out, "acta_id", facts, "seq", among=is_sheet, min_rows=2)
    in_batch = F.when(
        F.col("_previa.seq") != F.col("seq"), F.struct(*[F.col(f"_previa.{n}") for n in _PREVIOUS])
    )
    if stored is None:
        out = out.withColumn("previa", in_batch).drop("_previa")
    else:
        before = stored.select("acta_id", F.struct(*_PREVIOUS).alias("_guardada"))
        out = out.join(before, "acta_id", "left")
        out = out.withColumn(
            "previa", F.when(is_sheet, F.coalesce(F.col("_guardada"), in_batch))
        ).drop("_previa", "_guardada")
    out = out.withColumn(
        "estado_sms",
        F.when(F.col("etapa").isin(BY_PHONE, BY_PIN), K.SMS_RECHAZADO)
        .when(F.col("etapa") == BY_FORMAT, K.SMS_ERROR)
        .when(is_sheet & F.col("previa").isNotNull(), K.SMS_DUPLICADO_ESTADO)
        .when(is_sheet, K.SMS_PROCESADO),
    ).withColumn("canal", F.lit(K.SMS))
    if reference is None:
        return out.withColumn(
            "inconsistencias",
            F.when(is_sheet, F.concat(inc.arithmetic(), inc.conflicting_duplicate())).otherwise(
                F.array().cast(f"array<{inc._ISSUE}>")
            ),
        )
    return with_inconsistencies(out, reference, is_sheet)


def with_inconsistencies(rows: DataFrame, reference: DataFrame, judged) -> DataFrame:
    """Add the array of issues of the judged rows; the others get an empty one."""
    looked_up = inc.with_reference(rows.withColumn("consulta_referencia", judged), reference)
    found = F.concat(
        inc.arithmetic(), inc.contradictory(), inc.missing_times(), inc.conflicting_duplicate()
    )
    none = F.array().cast(f"array<{inc._ISSUE}>")
    return looked_up.withColumn("inconsistencias", F.when(judged, found).otherwise(none)).drop(
        "consulta_referencia", *[c for c in reference.columns]
    )


def _visual_ddl() -> str:
    from votecount.schemas import VISUAL

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in VISUAL.fields)


def sms_register(outcomes: DataFrame) -> DataFrame:
    """Register rows: the first message of each text, with its state and error list.

    Missing candidate numbers are kept as runs in ``huecos``; ``sms.error_lines`` prints them.
    """
    stage = F.col("etapa")
    exists = F.concat(F.lit("Acta "), "acta_id", F.lit(" ya existe en el sistema"))
    errors = (
        F.when(stage == BY_PHONE, F.array(F.lit("Teléfono no autorizado")))
        .when(stage == BY_FORMAT, F.col("errores_parseo"))
        .when(stage == BY_PIN, F.array(F.lit("PIN de verificación inválido")))
        .when(F.col("estado_sms") == K.SMS_DUPLICADO_ESTADO, F.array(exists))
        .otherwise(F.array().cast("array<string>"))
    )
    gaps = F.when(stage == BY_FORMAT, F.col("huecos")).otherwise(
        F.array().cast("array<struct<desde:bigint,hasta:bigint>>")
    )
    sheet_id = F.when(stage.isin(BY_PHONE, BY_FORMAT), F.lit("")).otherwise(F.col("acta_id"))
    return outcomes.where("es_primero").select(
        "telefono", "mensaje_raw", "hash_mensaje", sheet_id.alias("acta_id"),
        F.col("estado_sms").alias("estado"), errors.alias("errores"), gaps.alias("huecos"), "fecha_recepcion", "seq",
    )


def sms_sheets(outcomes: DataFrame) -> DataFrame:
    """Sheets to store: one per id, from the messages that got all the way."""
    from votecount.schemas import SHEET

    kept = outcomes.where(F.col("estado_sms") == K.SMS_PROCESADO)
    return kept.select(*SHEET.fieldNames(), "seq")


def issues_of(outcomes: DataFrame) -> DataFrame:
    """Inconsistency log rows of judged messages or files."""
    return (
        outcomes.where(F.size("inconsistencias") > 0)
        .select("acta_id", F.explode("inconsistencias").alias("_i"), F.col("canal").alias("fuente"),
                F.col("fecha_recepcion").alias("fecha"))
        .select("acta_id", "_i.*", "fuente", "fecha")
        .select(*inc.OUTPUT)
    )


# --- files --------------------------------------------------------------------

STORED, SAME_FILE, SAME_SHEET = "GUARDADA", "DUPLICADO_HASH", "DUPLICADO_ACTA"


def greedy_first(files: DataFrame) -> DataFrame:
    """Which files are stored when each one needs a hash and an id not stored before.

    A missing hash is shared with no other file and blocks none; a missing id counts as an id.

    Input columns: seq, fecha_recepcion, hash_origen, acta_id. Output: seq, resultado and
    ``previo`` (seq of the stored file that blocks it, NULL for stored ones).
    """
    keys = kept(_keys(files))
    out = keys.select("seq").join(contested(keys), "seq", "left")
    return out.withColumn("resultado", F.coalesce("resultado", F.lit(STORED)))


def _keys(files: DataFrame) -> DataFrame:
    arrival = stamp(F.col("fecha_recepcion"), F.col("seq")).alias("orden")
    own_hash = F.coalesce(F.concat(F.lit("="), "hash_origen"), F.concat(F.lit("-"), F.col("seq").cast("string")))
    own_id = F.coalesce(F.concat(F.lit("="), "acta_id"), F.lit(""))
    return files.select("seq", arrival, own_hash.alias("hash_origen"), own_id.alias("acta_id"))


def contested(keys: DataFrame) -> DataFrame:
    """seq, resultado and ``previo`` of the files that share a hash or an id; all others are stored.

    The files that may share one are found by digests of 8 bytes, with few that share none
    among them; from there on the hashes and ids themselves count. One is stored when it
    is the earliest of its hash and of its id among the files still open; whatever shares a
    hash or id with it can then no longer be stored. That repeats until nothing is open; every
    round stores at least one file, and nearly always one is enough, because the text decides
    the id unless only the file name holds the code. Each round is cut off from the ones
    before, so lost executors replay one round only.

    ``keys`` is read several times: seq, orden, hash_origen and acta_id, none of them NULL.
    """
    digests = F.array(F.xxhash64(F.lit("hash"), "hash_origen"), F.xxhash64(F.lit("id"), "acta_id"))
    marks = keys.select("seq", F.explode(digests).alias("_marca"))
    repeated = marks.groupBy("_marca").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_marca")
    sharing = marks.join(repeated, "_marca", "left_semi").select("seq")
    every = open_ = cut(keys.join(sharing, "seq", "left_semi"))
    stored = every.limit(0)
    while not open_.isEmpty():
        first_hash = open_.groupBy("hash_origen").agg(F.min("orden").alias("orden")).select("orden")
        first_id = open_.groupBy("acta_id").agg(F.min("orden").alias("orden")).select("orden")
        fresh = cut(open_.join(first_hash, "orden", "left_semi").join(first_id, "orden", "left_semi"))
        stored = stored.unionByName(fresh)
        open_ = cut(
            open_.join(fresh.select("hash_origen"), "hash_origen", "left_anti").join(
                fresh.select("acta_id"), "acta_id", "left_anti"
            )
        )
    return _label(every, stored)


def storable_sheets(sheets: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The sheets to append: as if each in turn needed an id and a hash not stored before.

    A sheet that is refused itself does not stand in the way of a later one.
    """
    new = sheets
    if stored is not None:
        new = sheets.join(stored.select("acta_id"), "acta_id", "left_anti").join(
            stored.select("hash_origen"), "hash_origen", "left_anti"
        )
    # The rounds and the result read a copy of the keys, so the sheets are worked out twice in all.
    keys = kept(_keys(new))
    refused = contested(keys).where(F.col("resultado") != STORED)
    return sheets.join(keys.select("seq").join(refused, "seq", "left_anti"), "seq", "left_semi")


def _label(every: DataFrame, stored: DataFrame) -> DataFrame:
    """What each file ran into, as things stood when it arrived; the hash is checked first."""
    per_hash = stored.select("hash_origen", F.col("seq").alias("_sh"), F.col("orden").alias("_oh"))
    per_id = stored.select("acta_id", F.col("seq").alias("_si"))
    seen = every.join(per_hash, "hash_origen", "left").join(per_id, "acta_id", "left")
    result = (
        F.when(F.col("_sh") == F.col("seq"), STORED)
        .when(F.col("_oh") < F.col("orden"), SAME_FILE)
        .otherwise(SAME_SHEET)
    )
    blocker = F.when(result == SAME_FILE, F.col("_sh")).when(result == SAME_SHEET, F.col("_si"))
    return seen.select("seq", result.alias("resultado"), blocker.alias("previo"))


def judge_files(
    files: DataFrame,
    keep_parser_errors: bool = False,
    stored: DataFrame | None = None,
    previous: bool = True,
    copies: list[str] | None = None,
) -> DataFrame:
    """Parsed, validated files with ``resultado`` and, unless ``previous`` is off, the sheet before.

    ``files``: sheets from text with seq, fecha_recepcion, hash_origen and
    validacion_visual. Only one of ``resultado`` GUARDADA exists per hash and per id.
    ``stored`` holds the sheets kept before, of whatever channel (acta_id, the numbers and
    hash_origen): a file with a stored hash is that file again, one with a stored id is a
    duplicate of that sheet, and neither stands in the way of others.
    """
    # Parsed once; the rounds, the result and the look-up of earlier sheets read this copy.
    sheets = kept(validate_sheets(files, keep_parser_errors), copies)
    known = F.struct("acta_id", *_PREVIOUS)
    keys = sheets.select("seq", "fecha_recepcion", "hash_origen", "acta_id")
    seen = None
    if stored is not None:
        # NULL hashes meet nothing; spread so that they do not meet in one partition.
        asked = F.coalesce(F.concat(F.lit("="), "hash_origen"), F.concat(F.lit("-"), F.col("seq").cast("string")))
        by_hash = stored.select(F.concat(F.lit("="), "hash_origen").alias("_h"), known.alias("_por_hash"))
        by_id = stored.select("acta_id", known.alias("_por_id"))
        met = keys.withColumn("_h", asked).join(by_hash, "_h", "left").join(by_id, "acta_id", "left")
        result = F.when(F.col("_por_hash").isNotNull(), SAME_FILE).when(F.col("_por_id").isNotNull(), SAME_SHEET)
        met = met.select("seq", result.alias("resultado"), F.coalesce("_por_hash", "_por_id").alias("previa"))
        seen = kept(met.where(F.col("resultado").isNotNull()), copies)
        keys = keys.join(seen, "seq", "left_anti")
    keys = _keys(keys)
    # Only files that share a hash or an id have a verdict of their own; the others are stored.
    verdicts = contested(keys if seen is None else kept(keys, copies))
    if previous:
        before = sheets.select(F.col("seq").alias("previo"), known.alias("previa"))
        blocked = verdicts.where(F.col("previo").isNotNull()).join(before, "previo")
        verdicts = blocked.select("seq", "resultado", "previa")
        if seen is not None:
            verdicts = verdicts.unionByName(seen)
    else:
        verdicts = verdicts.where(F.col("previo").isNotNull()).select("seq", "resultado")
        if seen is not None:
            verdicts = verdicts.unionByName(seen.select("seq", "resultado"))
    return sheets.join(verdicts, "seq", "left").withColumn("resultado", F.coalesce("resultado", F.lit(STORED)))


def upload_outcomes(
    files: DataFrame,
    reference: DataFrame,
    keep_parser_errors: bool = False,
    stored: DataFrame | None = None,
    copies: list[str] | None = None,
) -> DataFrame:
    """The judged files (``judge_files``) with their inconsistencies."""
    out = judge_files(files, keep_parser_errors, stored, copies=copies).withColumn("canal", F.lit("UPLOAD"))
    return with_inconsistencies(out, reference, F.col("resultado") != SAME_FILE)
