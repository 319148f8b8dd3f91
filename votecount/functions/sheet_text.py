"""Tally sheets from extracted text.

Two kinds of text are read: embedded text (marked, one value per line in a known order)
and OCR text (labels and digit triplets anywhere). Everything is expressions over the
array of lines, so a whole corpus is one narrow map without any Python per row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.ocr import digits_only, ocr_number
from votecount.functions.scalars import compact, strict_int, sum_votes, translated, trim_all
from votecount.functions.steps import once

# Patterns of labels and digit groups. (?iu) folds accented letters too and
# \z is the very end of the text.
_LETTERS = r"A-ZÁÉÍÓÚÑa-záéíóúñ\s"
P_CODE_LABEL = r"(?iu)C[OÓ0]DIGO\s+DE\s+MESA[:\s]*([0-9]{10,16})"
P_CODE_BARE = r"(?<![0-9A-Za-z_])([0-9]{13,16})(?![0-9A-Za-z_])"
P_TABLE = r"(?iu)N[UÚ]MERO\s+DE\s+MESA[:\s]*([0-9]{1,3})"
P_DEPARTMENT = rf"(?iu)Departamento[:\s]+([{_LETTERS}]+?)(?:\s*\z|\s*Provincia|\s*[0-9])"
P_PROVINCE = rf"(?iu)Provincia[:\s]+([{_LETTERS}]+?)(?:\s*\z|\s*Municipio|\s*[0-9])"
P_MUNICIPALITY = rf"(?iu)Municipio[:\s]+([{_LETTERS}]+?)(?:\s*\z|\s*Localidad|\s*[0-9])"
P_PRECINCT = rf"(?iu)Recinto[:\s]+([{_LETTERS}.]+?)(?:\s*\z|\s*[0-9])"
P_PRECINCT_LABEL = r"(?i)R[eE][cC][iIlL1][nN][tT][oO0]"
P_VALID = r"(?iu)VOTOS\s+V[ÁA]LIDOS[:\s]*([0-9][0-9\s]{0,8}[0-9])"
P_BLANK = r"(?iu)VOTOS\s+BLANCOS[:\s]*([0-9][0-9\s]{0,8}[0-9])"
P_NULL = r"(?iu)VOTOS\s+NULOS[:\s]*([0-9][0-9\s]{0,8}[0-9])"
P_FILE_CODE = r"acta_([0-9]+)"
_E = "[0-9OlIBSZG|]"
P_EMBEDDED_TRIPLET = rf"^{_E}\s*{_E}\s*{_E}\z"
_O = "[0-9OolIBbSsZzGg|]"
P_OCR_TRIPLET = rf"(?:^|[ \t]){_O}[ \t]{{0,4}}{_O}[ \t]{{0,4}}{_O}(?:[ \t]|\z)"
P_OCR_TAIL = r"(?:^|\s)([0-9]{3})\s*\z"
OCR_LINE_BYTES = 120
OCR_TAIL_LETTERS = 2
TRIPLETS_NEEDED = 7
# In both kinds of triplet a letter outside the look-alike list counts as 0.
_TRIPLET_DIGITS = K.LOOKALIKES_DIGIT | dict.fromkeys("bszg", "0")


def annulled_text(text: Column, strict_annul: bool = False) -> Column:
    """Text that marks the sheet as void anywhere in it.

    The wide reading also fires on a printed "VOTOS NULOS"; ``strict_annul`` does not.
    """
    return F.upper(text).rlike("ANULAD" if strict_annul else "ANULAD|NULA|NULO")


def department_from_text(text: Column) -> Column:
    """First department of the list whose name occurs in the text, else ''."""
    upper = F.upper(text)
    hits = [F.when(F.contains(upper, F.lit(d.upper())), F.lit(d)) for d in K.DEPARTMENTS]
    return F.coalesce(*hits, F.lit(""))


def code_from_file(file_name: Column) -> Column:
    return F.regexp_extract(file_name, P_FILE_CODE, 1)


def _first(items: Column) -> Column:
    return F.coalesce(F.get(items, 0), F.lit(""))


def _as_triplet(chars: Column) -> Column:
    return translated(F.regexp_replace(chars, r"\s", ""), _TRIPLET_DIGITS).cast("bigint")


def embedded_triplets(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x.rlike(P_EMBEDDED_TRIPLET)), _as_triplet)


def ocr_triplets(lines: Column) -> Column:
    """One value per line that holds a spaced triplet, or ends in three digits."""

    def value(line):
        few_letters = F.length(F.regexp_replace(line, "[^A-Za-z]", "")) <= OCR_TAIL_LETTERS
        tail = F.regexp_extract(line, P_OCR_TAIL, 1)
        return (
            F.when((line == "") | (F.octet_length(line) > OCR_LINE_BYTES), None)
            .when(line.rlike(P_OCR_TRIPLET), _as_triplet(F.regexp_extract(line, P_OCR_TRIPLET, 0)))
            .when(few_letters & (tail != ""), tail.cast("bigint"))
        )

    return F.array_compact(F.transform(lines, value))


def last_number(line: Column) -> Column:
    """Number at the end of a line: three digits if there are three, else what is there."""
    three_at_end = F.regexp_extract(line, r"([0-9]\s*[0-9]\s*[0-9])\s*\z", 1)
    threes = F.regexp_extract_all(line, F.lit(r"([0-9]\s*[0-9]\s*[0-9])"), 1)
    short = F.regexp_extract(line, r"([0-9]{1,3})\s*\z", 1)
    return (
        F.when(three_at_end != "", ocr_number(three_at_end))
        .when(F.size(threes) > 0, ocr_number(F.element_at(threes, -1)))
        .otherwise(F.coalesce(strict_int(short), F.lit(0).cast("bigint")))
    )


def votes_by_name(lines: Column, candidate: str) -> Column:
    """Number on the first line that names the candidate (or a known misreading)."""
    names = "|".join(K.SURNAME_SPELLINGS[candidate])
    named = F.get(F.filter(lines, lambda x: F.lower(x).rlike(names)), 0)
    return F.when(named.isNotNull(), last_number(named)).otherwise(F.lit(0).cast("bigint"))


def ocr_code(text: Column) -> Column:
    labelled = F.regexp_extract(text, P_CODE_LABEL, 1)
    return F.when(labelled != "", digits_only(labelled)).otherwise(
        F.regexp_extract(text, P_CODE_BARE, 1)
    )


def ocr_precinct(text: Column, lines: Column) -> Column:
    """Place on the label's own line, or on the line below it."""
    same_line = F.nullif(trim_all(F.regexp_extract(text, P_PRECINCT, 1)), F.lit(""))
    below = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("")))

    def value(line, following):
        rest = trim_all(
            F.regexp_replace(F.regexp_replace(line, P_PRECINCT_LABEL, ""), r"^[:. ]+", "")
        )
        usable = (F.octet_length(following) > 2) & ~following.rlike(r"^[0-9]+\z")
        return F.when(
            line.rlike(P_PRECINCT_LABEL),
            F.when(F.octet_length(rest) > 2, rest).when(usable, following),
        )

    labelled = F.get(F.array_compact(F.zip_with(lines, below, value)), 0)
    return F.coalesce(same_line, labelled, F.lit(""))


def decode_triplets(t: Column) -> dict[str, Column]:
    """Counts by position from the end; NULL where there are too few triplets."""
    enough = F.size(t) >= TRIPLETS_NEEDED
    at = lambda i: F.try_element_at(t, F.lit(i))
    extra = lambda i: F.coalesce(F.when(F.size(t) >= 10, at(i)), F.lit(0).cast("bigint"))
    return {
        "t_c1": F.when(enough, at(-7)),
        "t_c2": F.when(enough, at(-6)),
        "t_c3": F.when(enough, at(-5)),
        "t_c4": F.when(enough, at(-4)),
        "t_validos": F.when(enough, at(-3)),
        "t_blancos": F.when(enough, at(-2)),
        "t_nulos": F.when(enough, at(-1)),
        "electores_habilitados": extra(-10),
        "papeletas_anfora": extra(-9),
        "papeletas_no_utilizadas": extra(-8),
    }


def _split_lines(df: DataFrame) -> DataFrame:
    text = F.col("text")
    after = F.substring(
        text, F.instr(text, K.EMBEDDED_MARKER) + len(K.EMBEDDED_MARKER), F.length(text)
    )
    out = df.withColumn("_emb", F.contains(text, F.lit(K.EMBEDDED_MARKER)))
    body = F.when(F.col("_emb"), after).otherwise(text)
    lines = F.transform(F.split(body, "\n"), trim_all)
    # Empty lines only matter where a label's value may be on the line below.
    kept = F.filter(lines, lambda x: (x != "") | ~F.col("_emb"))
    return once(out, {"_lineas": kept})


def parse_sheet_text(df: DataFrame, strict_annul: bool = False) -> DataFrame:
    """Sheets from (file_name, text, ...): the text column is replaced by sheet columns.

    Errors found while parsing come in ``errores_texto`` and the state they alone imply in
    ``estado`` / ``motivo_estado``.
    """
    text, lines, emb = F.col("text"), F.col("_lineas"), F.col("_emb")
    line = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    out = _split_lines(df)
    out = once(
        out,
        {
            "_n": F.size(lines),
            "_corto": emb & (F.size(lines) < 3),
            "_anulada": annulled_text(text, strict_annul),
            "_codigo": F.when(
                emb, _first(F.filter(lines, lambda x: x.rlike(r"^[0-9]{13,16}\z")))
            ).otherwise(ocr_code(text)),
            "_t": F.when(emb, embedded_triplets(lines)).otherwise(ocr_triplets(lines)),
        },
    )
    ocr_text = lambda c: F.when(~emb, c).otherwise(F.lit(""))
    emb_line = lambda c: F.when(emb & ~F.col("_corto"), c)
    after_code = F.slice(lines, F.array_position(lines, F.col("_codigo")) + 1, F.col("_n") + 1)
    emb_table = F.when(
        F.col("_codigo") != "", _first(F.filter(after_code, lambda x: x.rlike(r"^[0-9]{1,2}\z")))
    )
    emb_place = F.when(F.octet_length(line(4)) > F.octet_length(line(3)), line(4)).otherwise(line(3))
    filled = lambda c: F.nullif(c, F.lit(""))
    labelled = lambda p: trim_all(F.regexp_extract(text, p, 1))
    # The place names are read by nothing below, so they stay a projection that is dropped
    # where nobody asks for them.
    out = out.withColumns(
        {
            "departamento": F.coalesce(
                emb_line(line(0)),
                ocr_text(F.coalesce(filled(labelled(P_DEPARTMENT)), department_from_text(text))),
            ),
            "provincia": F.coalesce(emb_line(line(1)), ocr_text(labelled(P_PROVINCE))),
            "municipio": F.coalesce(emb_line(line(2)), ocr_text(labelled(P_MUNICIPALITY))),
            "recinto": F.coalesce(emb_line(emb_place), ocr_text(ocr_precinct(text, lines))),
        }
    )
    out = once(
        out,
        {
            "_codigo": F.when(F.col("_corto"), "").otherwise(F.col("_codigo")),
            "_mesa": F.coalesce(
                emb_line(emb_table), ocr_text(digits_only(F.regexp_extract(text, P_TABLE, 1)))
            ),
            "_t": F.when(F.col("_corto"), F.array().cast("array<bigint>")).otherwise(F.col("_t")),
        },
    )
    out = out.withColumns(
        {
            "codigo_mesa": F.when(F.col("_codigo") != "", F.col("_codigo")).otherwise(
                code_from_file(F.col("file_name"))
            ),
            **decode_triplets(F.col("_t")),
        }
    )
    total = lambda p: ocr_number(F.regexp_extract(text, p, 1))
    by_position = F.size("_t") >= TRIPLETS_NEEDED
    count = lambda name, p: F.when(by_position, F.col(name)).when(~emb, total(p)).otherwise(
        F.lit(0).cast("bigint")
    )

    def candidate(i):
        votes = F.when(by_position, F.col(f"t_c{i}")).otherwise(votes_by_name(lines, f"C{i}"))
        return F.struct(F.lit(f"C{i}").alias("candidato_id"), votes.alias("votos"))

    tail = F.regexp_extract("codigo_mesa", r"([0-9]{3})\z", 1)
    mesa = (
        F.when(F.col("_mesa") != "", F.col("_mesa"))
        .when(tail != "", tail.cast("int").cast("string"))
        .otherwise("")
    )
    out = once(
        out,
        {
            "mesa": mesa,
            "candidatos": F.when(
                by_position | ~emb, F.array(*[candidate(i) for i in range(1, 5)])
            ).otherwise(F.array().cast("array<struct<candidato_id:string,votos:bigint>>")),
            "votos_validos": count("t_validos", P_VALID),
            "votos_blancos": count("t_blancos", P_BLANK),
            "votos_nulos": count("t_nulos", P_NULL),
        },
    )
    out = out.withColumns(
        {
            "acta_id": F.when(F.col("codigo_mesa") != "", F.concat(F.lit("MESA-"), "codigo_mesa"))
            .when(F.col("mesa") != "", F.concat(F.lit("MESA-"), "mesa"))
            .otherwise(F.concat(F.lit("MESA-DESCONOCIDA-"), "file_name")),
            "total_votos": F.col("votos_validos") + F.col("votos_blancos") + F.col("votos_nulos"),
            "_suma": sum_votes(F.col("candidatos")),
        }
    )
    few = F.concat(
        F.lit("solo se encontraron "), F.size("_t").cast("string"),
        F.lit(" tripletes de votos (se necesitan mínimo 7)"),
    )
    sum_off = F.concat(
        F.lit("inconsistencia aritmética: suma_candidatos("), F.col("_suma").cast("string"),
        F.lit(") != votos_válidos("), F.col("votos_validos").cast("string"), F.lit(")"),
    )
    out = out.withColumn(
        "errores_texto",
        compact(
            F.when(F.col("_anulada"), F.lit("Acta marcada como ANULADA")),
            F.when(F.col("_corto"), F.lit("texto embebido insuficiente")).when(
                emb & ~by_position, few
            ),
            F.when(
                (F.col("codigo_mesa") == "") & (F.col("mesa") == ""),
                F.lit("no se pudo determinar ID del acta"),
            ),
            F.when(
                (F.col("votos_validos") > 0)
                & (F.size("candidatos") > 0)
                & (F.col("_suma") != F.col("votos_validos")),
                sum_off,
            ),
        ),
    )
    out = out.withColumns(
        {
            "estado": F.when(F.col("_anulada"), K.ANULADA)
            .when(F.size("errores_texto") > 0, K.ERROR)
            .otherwise(K.PROCESADA),
            "motivo_estado": F.when(F.col("_anulada"), K.TEXTO_ANULADA).otherwise(""),
            "fuente": F.lit(K.RRV),
            "tipo_entrada": F.lit(K.PDF),
        }
    )
    drop = ["text", "_emb", "_lineas", "_n", "_corto", "_anulada", "_codigo", "_t", "_mesa", "_suma"]
    return out.drop(*drop, *[c for c in out.columns if c.startswith("t_")])
