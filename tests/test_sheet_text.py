"""Sheets out of embedded and OCR text."""

import pytest
from pyspark.sql import functions as F

from votecount.functions import ocr
from votecount.functions import sheet_text as st

MARK = "--- FUENTE: TEXTO_EMBEBIDO ---\n"
HEAD = "Chuquisaca\nOropeza\nYotala\nU.E. Padresama\nCarretera km 150 a Santa Cruz\n\n"
VOTES = "0 4 0\n0 3 O\n0 2 0\n0 l 0\n1 0 0\n0 0 5\n0 0 2\n"


def parse(spark, text, name="acta_77.pdf", **kw):
    df = spark.createDataFrame([(name, text)], "file_name string, text string")
    return st.parse_sheet_text(df, **kw).collect()[0]


def counts(r):
    return [c.votos for c in r.candidatos] + [r.votos_validos, r.votos_blancos, r.votos_nulos]


def test_embedded_seven_triplets(spark):
    r = parse(spark, MARK + HEAD + "1010200001001\n\n1\n" + VOTES)
    assert (r.departamento, r.provincia, r.municipio) == ("Chuquisaca", "Oropeza", "Yotala")
    assert r.recinto == "Carretera km 150 a Santa Cruz"
    assert (r.codigo_mesa, r.mesa, r.acta_id) == ("1010200001001", "1", "MESA-1010200001001")
    assert counts(r) == [40, 30, 20, 10, 100, 5, 2] and r.total_votos == 107
    assert (r.electores_habilitados, r.estado, r.errores_texto) == (0, "PROCESADA", [])


def test_embedded_ten_triplets(spark):
    r = parse(spark, MARK + HEAD + "1010200001001\n1\n0 8 0\n1 6 0\n1 5 0\n1 0 7\n0 4 3\n" + VOTES)
    assert (r.electores_habilitados, r.papeletas_anfora, r.papeletas_no_utilizadas) == (150, 107, 43)


def test_embedded_six_triplets_is_an_error(spark):
    r = parse(spark, MARK + HEAD + "1010200001001\n1\n" + VOTES.split("\n", 1)[1])
    assert r.candidatos == [] and r.estado == "ERROR"
    assert r.errores_texto == ["solo se encontraron 6 tripletes de votos (se necesitan mínimo 7)"]


def test_embedded_too_short(spark):
    r = parse(spark, MARK + "\f\n uno \n\n1010200001001\n", name="x.pdf")
    assert r.errores_texto == ["texto embebido insuficiente", "no se pudo determinar ID del acta"]
    assert r.acta_id == "MESA-DESCONOCIDA-x.pdf"


def test_code_only_in_file_name(spark):
    r = parse(spark, MARK + HEAD + VOTES, name="acta_1010200001023.pdf")
    assert (r.codigo_mesa, r.mesa) == ("1010200001023", "23")


@pytest.mark.parametrize(
    "chars, value", [("OlI", 11), ("|BS", 185), ("ZG9", 269), ("1 2 3", 123), ("1  2\t3", 123)])
def test_lookalikes(spark, chars, value):
    (r,) = spark.createDataFrame([([chars],)], "l array<string>").select(
        st.embedded_triplets(F.col("l")).alias("t")).collect()
    assert r.t == [value]


OCR = """ACTA ELECTORAL
CÓDIGO DE MESA: 1010200001001
NÚMERO DE MESA: 12
Departamento : La Paz Provincia : Murillo
Municipio : El Alto
Localidad : Centro
Recinto : U.E. San José
"""
SPACED = "\n".join(f"casilla {v}" for v in ("0 4 0", "0 3 0", "0 2 0", "0 1 0", "1 O 0", "0 0 5", "0 0 z"))


def test_ocr_labels_and_triplets(spark):
    r = parse(spark, OCR + SPACED)
    assert (r.codigo_mesa, r.mesa, r.departamento) == ("1010200001001", "12", "La Paz")
    assert (r.provincia, r.municipio) == ("Murillo", "El Alto")
    assert counts(r) == [40, 30, 20, 10, 100, 5, 0]


def test_ocr_three_digits_at_line_end(spark):
    r = parse(spark, OCR + "\n".join(f"- {v}" for v in ("040", "030", "020", "010", "100", "005", "002")))
    assert counts(r) == [40, 30, 20, 10, 100, 5, 2]


def test_ocr_long_lines_do_not_count(spark):
    r = parse(spark, OCR + SPACED.rsplit("\n", 1)[0] + "\ncasilla 0 0 2 " + "ñ" * 60)
    assert r.votos_validos == 0


def test_ocr_names_and_labelled_totals(spark):
    text = OCR + "TARQARYEN 040\nStork 0 3 0\nBaratheon 20\nLannister\nVOTOS VALIDOS: 100\nVOTOS BLANCOS: 005\n"
    r = parse(spark, text)
    assert counts(r) == [40, 30, 20, 0, 100, 5, 0]
    assert r.errores_texto == ["inconsistencia aritmética: suma_candidatos(90) != votos_válidos(100)"]


def test_null_votes_label_annuls_unless_strict(spark):
    text = OCR + SPACED + "\nVOTOS NULOS\n"
    assert parse(spark, text).motivo_estado == "TEXTO_ANULADA"
    assert parse(spark, text, strict_annul=True).estado == "PROCESADA"
    assert parse(spark, OCR + "acta Anulada", strict_annul=True).estado == "ANULADA"


def test_department_by_name_and_place_below_label(spark):
    r = parse(spark, "mesa de POTOSÍ\nReclnto\nColegio Sur\n123")
    assert (r.departamento, r.recinto) == ("Potosí", "Colegio Sur")
    assert r.acta_id == "MESA-77"


def test_bare_code_needs_boundaries(spark):
    rows = [("x1010200001001y 1010200001002",), ("12345678901234567890",)]
    got = spark.createDataFrame(rows, "t string").select(st.ocr_code(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["1010200001002", ""]


def test_field_repair(spark):
    rows = [("1 4O",), ("l-2.B",), ("12W",), ("?7",)]
    got = spark.createDataFrame(rows, "t string").select(
        ocr.repaired_field(F.col("t")).alias("v"), ocr.is_suspicious(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("140", False), ("128", False), ("12?", True), ("7", False)]


def test_choose_pass_and_usable(spark):
    rows = [("1", "1" * 21), ("1", "1" * 22), ("a", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(
        ocr.choose_pass(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == ["1", "1" * 22, "a"]
    usable = spark.createDataFrame([("x" * 20 + "1",), ("  " + "x" * 19 + "1  ",), ("x" * 40,)], "t string")
    assert [r.u for r in usable.select(ocr.text_is_usable(F.col("t")).alias("u")).collect()] == [True, False, False]
