"""Text message parsing with built-in expressions.

A message is a bar-separated list of KEY:VALUE parts. Parsing adds these columns:
``campos`` (the parts that hold a colon), one column per known field, ``candidatos``,
``huecos`` and ``errores_parseo``. Later parts win over earlier ones with the same key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import strict_int, trim_all
from votecount.functions.steps import once

_TEXT_FIELDS = {"ACTA": "sms_acta", "DEP": "sms_dep", "MUN": "sms_mun", "REC": "sms_rec",
                "MESA": "sms_mesa", "PIN": "sms_pin"}
_COUNT_FIELDS = {"VAL": "sms_val", "NUL": "sms_nul", "BLA": "sms_bla"}

# What each required field is called in an error text.
_REQUIRED = {
    "ACTA": "ACTA",
    "DEP": "DEP (departamento)",
    "MUN": "MUN (municipio)",
    "MESA": "MESA",
    "VAL": "VAL (votos válidos)",
    "NUL": "NUL (votos nulos)",
    "BLA": "BLA (votos blancos)",
    "PIN": "PIN",
}


def sms_hash(message: Column) -> Column:
    return F.sha2(message, 256)


def authorised(phone: Column, phones) -> Column:
    """Phone on the allow-list of the configuration."""
    return F.coalesce(phone.isin(list(phones)), F.lit(False))


def _split_part(part: Column) -> Column:
    colon = F.instr(part, ":")
    return F.struct(
        part.alias("texto"),
        F.when(colon > 0, trim_all(F.upper(F.substring_index(part, ":", 1)))).alias("clave"),
        F.when(colon > 0, trim_all(F.substring(part, colon + 1, F.length(part)))).alias("valor"),
    )


def _is_candidate(key: Column) -> Column:
    # The prefix test spares most keys the pattern.
    return F.coalesce(F.startswith(key, F.lit("C")) & key.rlike(r"^C[0-9]+\z"), F.lit(False))


def _number(key: Column) -> Column:
    return F.substring(key, 2, 1 << 30).try_cast("bigint")


def _last(pairs: Column, key: Column | str) -> Column:
    """Value of the last pair with this key; ``pairs`` is in reverse order."""
    return F.get(pairs["valor"], F.array_position(pairs["clave"], key) - 1)


def _part_error(p: Column) -> Column:
    bad_votes = F.concat(F.lit("votos inválidos para "), p["clave"], F.lit(": '"), p["valor"], F.lit("'"))
    return (
        F.when(p["clave"].isNull(), F.concat(F.lit("campo mal formado: '"), p["texto"], F.lit("'")))
        .when(
            _is_candidate(p["clave"]) & _number(p["clave"]).isNull(),
            F.concat(F.lit("número de candidato inválido: "), p["clave"]),
        )
        .when(_is_candidate(p["clave"]) & strict_int(p["valor"]).isNull(), bad_votes)
    )


def _field_error(key: str) -> Column:
    missing = F.lit(f"campo obligatorio faltante: {_REQUIRED[key]}")
    raw = F.col(f"_raw_{key}")
    if key not in _COUNT_FIELDS:
        return F.when(raw.isNull(), missing)
    wrong = F.concat(F.lit(f"{_REQUIRED[key]} no es número: '"), raw, F.lit("'"))
    return F.when(raw.isNull(), missing).when(strict_int(raw).isNull(), wrong)


def _gaps(numbers: Column) -> Column:
    """Runs of numbers missing between 1 and the highest one, as (desde, hasta)."""
    known = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n >= 1)))
    # Each run of missing numbers ends right before a known number.
    starts = F.concat(F.array(F.lit(1).cast("bigint")), F.transform(known, lambda n: n + 1))
    return F.filter(
        F.zip_with(starts, known, lambda a, b: F.struct(a.alias("desde"), (b - 1).alias("hasta"))),
        lambda r: r["hasta"].isNotNull() & (r["desde"] <= r["hasta"]),
    )


def _gap_error(n: Column) -> Column:
    return F.concat(F.lit("candidato C"), n.cast("string"), F.lit(" faltante en la secuencia"))


def malformed() -> Column:
    return (F.size("errores_parseo") > 0) | (F.size("huecos") > 0)


def error_count() -> Column:
    """Errors of a parsed message: one for each text and for each missing candidate number."""
    missing = F.aggregate(
        "huecos", F.lit(0).cast("bigint"), lambda n, r: n + r["hasta"] - r["desde"] + 1
    )
    return F.size("errores_parseo") + missing


def first_errors(n: int) -> Column:
    """The first n error texts; no more of a run is spelled out than can be among them."""
    heads = F.transform(
        F.slice("huecos", 1, n),
        lambda r: F.transform(F.sequence(r["desde"], F.least(r["hasta"], r["desde"] + n - 1)), _gap_error),
    )
    return F.slice(F.concat("errores_parseo", F.flatten(heads)), 1, n)


_RUN = 1000


def _missing_numbers(df: DataFrame) -> DataFrame:
    """One row per missing number, column ``n``; runs are cut up, so no array is long."""
    runs = df.withColumn("_r", F.explode("huecos")).withColumn(
        "_d", F.explode(F.expr(f"sequence(0L, (_r.hasta - _r.desde) div {_RUN})"))
    )
    piece = F.expr(f"sequence(_r.desde + _d * {_RUN}, least(_r.hasta, _r.desde + _d * {_RUN} + {_RUN - 1}))")
    return runs.withColumn("n", F.explode(piece)).drop("_r", "_d")


def error_lines(df: DataFrame, key: str = "seq") -> DataFrame:
    """Every error of every message as a row: key, parte, orden, error.

    Parte 1 holds the errors of the parts and fields in their order, parte 2 the candidate
    numbers missing, by number.
    """
    texts = df.select(key, F.lit(1).alias("parte"), F.posexplode("errores_parseo").alias("orden", "error"))
    texts = texts.select(key, "parte", F.col("orden").cast("bigint").alias("orden"), "error")
    gaps = _missing_numbers(df.select(key, "huecos"))
    return texts.unionByName(
        gaps.select(key, F.lit(2).alias("parte"), F.col("n").alias("orden"), _gap_error(F.col("n")).alias("error"))
    )


def candidate_lines(df: DataFrame, key: str = "seq") -> DataFrame:
    """Every candidate from the first to the highest number, with 0 votes where one is missing."""
    gaps = _missing_numbers(df.select(key, "huecos")).select(
        key, F.concat(F.lit("C"), F.col("n").cast("string")).alias("candidato_id"),
        F.lit(0).cast("bigint").alias("votos"),
    )
    return df.select(key, F.inline("candidatos")).unionByName(gaps)


def parse_sms(df: DataFrame, message: str = "mensaje_raw", strict: bool = True) -> DataFrame:
    """Add the parsed fields of a message.

    ``candidatos`` holds the candidates sent, in order of their numbers; ``huecos`` the runs
    of numbers missing below the highest, whatever their length. ``candidate_lines`` and
    ``error_lines`` print them number by number.

    ``strict=False`` is the lenient report reading: parts without a colon are ignored
    and no error list is produced.
    """
    out = once(df, {"_partes": F.transform(F.split(F.col(message), r"\|"), _split_part)})
    out = once(out, {"_pares": F.reverse(F.filter("_partes", lambda p: p["clave"].isNotNull()))})
    keys = list(_TEXT_FIELDS) + list(_COUNT_FIELDS)
    votes = F.filter(
        F.transform(
            F.filter("_pares", lambda p: _is_candidate(p["clave"])),
            lambda p: F.struct(_number(p["clave"]).alias("n"), strict_int(p["valor"]).alias("v")),
        ),
        lambda c: c["n"].isNotNull() & c["v"].isNotNull(),
    )
    out = once(out, {**{f"_raw_{k}": _last(F.col("_pares"), k) for k in keys}, "_votos": votes})
    out = out.withColumns(
        {
            **{name: F.col(f"_raw_{k}") for k, name in _TEXT_FIELDS.items()},
            **{
                name: F.coalesce(strict_int(F.col(f"_raw_{k}")), F.lit(0).cast("bigint"))
                for k, name in _COUNT_FIELDS.items()
            },
            "_numeros": F.col("_votos")["n"],
        }
    )

    def candidate(n):
        return F.struct(
            F.concat(F.lit("C"), n.cast("string")).alias("candidato_id"),
            F.coalesce(
                F.get(F.col("_votos")["v"], F.array_position("_numeros", n) - 1),
                F.lit(0).cast("bigint"),
            ).alias("votos"),
        )

    numbers = F.array_sort(F.array_distinct(F.filter("_numeros", lambda n: n >= 1)))
    out = out.withColumns({"candidatos": F.transform(numbers, candidate), "huecos": _gaps(F.col("_numeros"))})
    if strict:
        none = F.when(F.size("_numeros") == 0, F.lit("no se encontraron candidatos (C1, C2, C3...)"))
        out = out.withColumn(
            "errores_parseo",
            F.concat(
                F.array_compact(F.transform("_partes", _part_error)),
                F.array_compact(F.array(*[_field_error(k) for k in _REQUIRED], none)),
            ),
        )
    drop = ["_partes", "_pares", "_votos", "_numeros"] + [f"_raw_{k}" for k in keys]
    return out.drop(*drop)


def parse_sms_star(df: DataFrame, message: str = "mensaje_raw") -> DataFrame:
    """Star-separated variant: id*valid*blank*null*votes1*votes2..."""
    parts = F.transform(F.split(F.col(message), r"\*"), trim_all)
    out = df.withColumn("_partes", parts)
    cell = lambda i: F.coalesce(strict_int(F.get("_partes", i)), F.lit(0).cast("bigint"))
    size = F.size("_partes")
    votes = F.when(size > 4, F.slice("_partes", 5, size)).otherwise(F.array().cast("array<string>"))
    wrong = F.exists(F.slice("_partes", 2, size), lambda v: strict_int(v).isNull())
    return out.withColumns(
        {
            "sms_acta": F.get("_partes", 0),
            "sms_val": cell(1),
            "sms_bla": cell(2),
            "sms_nul": cell(3),
            "candidatos": F.transform(
                votes,
                lambda v, i: F.struct(
                    F.concat(F.lit("C"), (i + 1).cast("string")).alias("candidato_id"),
                    F.coalesce(strict_int(v), F.lit(0).cast("bigint")).alias("votos"),
                ),
            ),
            "errores_parseo": F.array_compact(
                F.array(
                    F.when(F.coalesce(F.get("_partes", 0), F.lit("")) == "", F.lit("falta el id de mesa")),
                    F.when(size < 5, F.lit("faltan campos")),
                    F.when(wrong, F.lit("campo no numérico")),
                )
            ),
        }
    ).drop("_partes")


def sms_to_sheet(df: DataFrame) -> DataFrame:
    """Parsed messages in the sheet layout; the table number doubles as its code."""
    zero = F.lit(0).cast("bigint")
    passthrough = [c for c in df.columns if not c.startswith("sms_") and c not in ("candidatos",)]
    return df.select(
        *passthrough,
        F.col("sms_acta").alias("acta_id"),
        F.col("sms_mesa").alias("codigo_mesa"),
        F.col("sms_dep").alias("departamento"),
        F.lit("").alias("provincia"),
        F.col("sms_mun").alias("municipio"),
        F.coalesce("sms_rec", F.lit("")).alias("recinto"),
        F.col("sms_mesa").alias("mesa"),
        "candidatos",
        F.col("sms_val").alias("votos_validos"),
        F.col("sms_nul").alias("votos_nulos"),
        F.col("sms_bla").alias("votos_blancos"),
        (F.col("sms_val") + F.col("sms_nul") + F.col("sms_bla")).alias("total_votos"),
        zero.alias("electores_habilitados"),
        zero.alias("papeletas_anfora"),
        zero.alias("papeletas_no_utilizadas"),
        F.lit(K.RRV).alias("fuente"),
        F.lit(K.SMS).alias("tipo_entrada"),
        F.col("hash_mensaje").alias("hash_origen"),
    )
