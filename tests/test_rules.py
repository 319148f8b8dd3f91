"""Sheet validation, states, detectors, official rows and visual decisions."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from votecount import schemas
from votecount.functions import visual as vis
from votecount.operators import inconsistencies as inc
from votecount.operators import lookups as lk
from votecount.operators import official as off
from votecount.operators.validation import validate_sheets

CLEAN_IMAGE = dict(firmas_suficientes=True, huellas_detectadas=5)


def sheet(**changes):
    row = dict(
        acta_id="MESA-101", codigo_mesa="101", departamento="Beni", provincia="P", municipio="M",
        recinto="R", mesa="1", candidatos=[("C1", 6), ("C2", 4)], votos_validos=10, votos_nulos=1,
        votos_blancos=2, total_votos=13, electores_habilitados=20, papeletas_anfora=13,
        papeletas_no_utilizadas=7, estado=None, motivo_estado="", fuente="RRV", tipo_entrada="PDF",
        hash_origen="h", errores=None, validacion_visual=None, fecha_recepcion=datetime(2025, 8, 17, 20),
    )
    visual = changes.pop("visual", None)
    row.update(changes)
    if visual is not None:
        flags = {f.name: None for f in schemas.VISUAL.fields}
        flags.update({f.name: False for f in schemas.VISUAL.fields if f.dataType.simpleString() == "boolean"})
        flags.update(intensidad_promedio=120.0, ratio_contraste=0.5, porcentaje_mancha=4.2)
        flags.update(CLEAN_IMAGE)
        flags.update(visual)
        row["validacion_visual"] = tuple(flags[f.name] for f in schemas.VISUAL.fields)
    return tuple(row[f.name] for f in schemas.SHEET.fields)


def sheets(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SHEET)


CASES = [
    (dict(), "PROCESADA", "", 0),
    (dict(visual={}), "PROCESADA", "", 0),
    (dict(candidatos=[("C1", 6)]), "ERROR", "", 1),
    (dict(total_votos=14), "ERROR", "", 1),
    (dict(votos_nulos=-1, total_votos=11), "ERROR", "", 1),
    (dict(candidatos=[("C1", 11), ("C2", -1)]), "ERROR", "", 1),
    (dict(candidatos=[]), "ERROR", "", 1),
    (dict(departamento="", municipio="", mesa=""), "ERROR", "", 3),
    (dict(electores_habilitados=12), "ANULADA", "VOTOS_MAYOR_QUE_VOTANTES", 1),
    (dict(electores_habilitados=0), "PROCESADA", "", 0),
    (dict(visual=dict(lapiz_detectado=True)), "ANULADA", "USO_DE_LAPIZ", 1),
    (dict(visual=dict(corrector_detectado=True)), "ANULADA", "USO_DE_CORRECTOR", 1),
    (dict(visual=dict(tachadura_detectada=True)), "ANULADA", "TACHADURA_NUMEROS", 1),
    (dict(visual=dict(rotura_detectada=True)), "ANULADA", "ROTURA_CRITICA", 1),
    (dict(visual=dict(texto_anulada_visual=True, lapiz_detectado=True)), "ANULADA", "TEXTO_ANULADA_VISUAL", 2),
    (dict(visual=dict(firmas_suficientes=False, huellas_detectadas=2)), "ANULADA", "FALTA_FIRMAS_HUELLAS", 1),
    (dict(visual=dict(mancha_detectada=True)), "OBSERVADA", "MANCHA_SOBRE_DATOS", 1),
    (dict(visual=dict(mancha_detectada=True), total_votos=14), "ERROR", "", 2),
    (dict(visual=dict(numeros_sobreescritos=True, arrugas_detectadas=True)), "PROCESADA", "", 0),
    (dict(estado="ANULADA"), "ANULADA", "TEXTO_ANULADA", 0),
    (dict(votos_validos=0, total_votos=3), "PROCESADA", "", 0),
]


@pytest.mark.parametrize("changes, state, reason, errors", CASES)
def test_states(spark, changes, state, reason, errors):
    (r,) = validate_sheets(sheets(spark, sheet(**changes))).collect()
    assert (r.estado, r.motivo_estado, len(r.errores)) == (state, reason, errors)


def reference(spark):
    printed = spark.createDataFrame(
        [(101, 20), (102, 20), (103, 0)], "codigo_acta long, votantes_habilitados long")
    trans = spark.createDataFrame(
        [(101, 13, "8", "16"), (102, 0, None, " "), (103, 13, "0", "16")],
        "codigo_acta long, papeletas_anfora long, apertura_hora string, cierre_hora string")
    return inc.reference_frame(printed, trans)


@pytest.mark.parametrize(
    "changes, kinds",
    [
        (dict(), []),
        (dict(candidatos=[("C1", 9)]), [("INCONSISTENCIA_ARITMETICA", "CRITICA")]),
        (dict(total_votos=12), [("INCONSISTENCIA_ARITMETICA", "ALTA")]),
        (dict(electores_habilitados=21), [("DATOS_CONTRADICTORIOS", "ALTA")]),
        (dict(votos_nulos=9, total_votos=21, electores_habilitados=0), [("DATOS_CONTRADICTORIOS", "CRITICA")]),
        (dict(papeletas_anfora=12), [("DATOS_CONTRADICTORIOS", "ALTA")]),
        (dict(papeletas_anfora=0), []),
        (dict(acta_id="MESA-102", papeletas_anfora=12), [("FALTA_APERTURA_CIERRE", "MEDIA")] * 2),
        (dict(acta_id="MESA-103"), [("FALTA_APERTURA_CIERRE", "MEDIA")]),
        (dict(acta_id="MESA-DESCONOCIDA-x", electores_habilitados=99), []),
        (dict(acta_id="MESA-999", electores_habilitados=99), []),
    ],
)
def test_detectors(spark, changes, kinds):
    rows = sheets(spark, sheet(**changes)).withColumn(
        "previa", F.lit(None).cast(
            "struct<votos_validos:long,votos_nulos:long,votos_blancos:long,departamento:string,hash_origen:string>"))
    got = inc.detect_all(rows, reference(spark), source="UPLOAD").collect()
    assert [(g.tipo, g.severidad) for g in got] == kinds


def test_earlier_sheet(spark):
    def found(department, valid):
        previous = F.struct(
            F.lit(10).cast("long").alias("votos_validos"), F.lit(1).cast("long").alias("votos_nulos"),
            F.lit(2).cast("long").alias("votos_blancos"), F.lit("Beni").alias("departamento"),
            F.lit("h0").alias("hash_origen"))
        rows = sheets(spark, sheet(departamento=department, votos_validos=valid)).withColumn("previa", previous)
        return inc.conflicting_duplicates(rows, "SMS").count()

    assert found("Beni", 10) == 0 and found("", 10) == 0
    assert found("Pando", 10) == 1 and found("Beni", 11) == 1


def test_official_rules_in_order(spark):
    columns = ("fila long, codigo_acta long, p1 long, p2 long, p3 long, p4 long, votos_validos long, "
               "votos_blancos long, votos_nulos long, papeletas_anfora long, papeletas_no_utilizadas long")
    good = (1, 2, 3, 4, 10, 1, 1, 12, 8)
    rows = [
        (1, 5, *good),
        (2, 99, *good),
        (3, 6, 1, 2, 3, 5, 10, 1, 1, 12, 8),
        (4, 6, 1, 2, 3, 4, 10, 1, 1, 13, 7),
        (5, 6, 1, 2, 3, 4, 10, 1, 1, 12, 9),
        (6, 6, *good),
        (7, 6, *good),
        (8, 7, *good),
        (9, None, *good),
    ]
    mesas = spark.createDataFrame([(5, 20), (6, 20), (7, 20)], "codigo_acta long, votantes_habilitados long")
    done = spark.createDataFrame([(7,)], "codigo_acta long")
    got = {r.fila: r.motivo for r in off.validate_official(
        spark.createDataFrame(rows, columns), mesas, done).collect()}
    assert got[1] is None and got[6] is None
    assert got[2] == got[9] == "Acta no encontrada"
    assert got[3].startswith("La suma") and got[4].startswith("Los votos") and got[5].startswith("Las papeletas")
    assert got[7] == got[8] == "El acta ya fue transcrita"


def test_negative_count_is_named(spark):
    row = Row(p1=1, p2=2, p3=3, p4=-4, votos_validos=2, votos_blancos=-1, votos_nulos=0,
              papeletas_anfora=1, papeletas_no_utilizadas=0)
    (r,) = off.prevalidate_rows(spark.createDataFrame([row])).collect()
    assert r.motivo == 'campo "P4" es negativo (-4)'


def test_find_mesa_by_place_and_number(spark):
    mesas = spark.createDataFrame([(1, 10, 3, 50), (2, 10, 4, 60)],
                                  "codigo_acta long, codigo_recinto long, nro_mesa int, votantes_habilitados long")
    places = spark.createDataFrame([(10, "Sol", 1, "P")],
                                   "codigo_recinto long, recinto string, codigo_territorial int, provincia string")
    land = spark.createDataFrame([(1, "Beni", "M")], "codigo_territorial int, departamento string, municipio string")
    done = spark.createDataFrame([(2,)], "codigo_acta long")
    find = lambda **k: off.find_mesa(mesas, places, land, done, **k).collect()
    assert [r.codigo_acta for r in find(codigo_recinto=10, nro_mesa=3)] == [1]
    assert find(codigo_acta=2) == [] and find(codigo_acta=9) == []


def test_placeholder(spark):
    df = spark.createDataFrame([("Beni", 5, 3)], "Departamento string, VantantesX long, VotosValidos long")
    df = df.withColumnRenamed("VantantesX", "VotantesHabilitados")
    assert lk.with_placeholder(df).count() == 1
    (r,) = lk.with_placeholder(df.where("VotosValidos > 9")).collect()
    assert tuple(r) == ("Sin Datos", 1, 0)


def test_overwritten_cells_are_bounded_by_the_grid(spark):
    cells = spark.range(5000).select(
        F.lit("A").alias("acta_id"), (F.col("id") % 20 + 1).cast("int").alias("fila"),
        (F.col("id") % 3 + 1).cast("int").alias("columna"), F.lit(0.9).alias("density"), F.lit(0).alias("branches"))
    (r,) = vis.overwritten_cells(cells).collect()
    assert len(r.celdas_sobreescritas) == 42 and r.celdas_sobreescritas[0] == "fila1_col1"


def test_merge_observations_keeps_repeats_of_the_second(spark):
    df = spark.createDataFrame([(["x"], ["x", "y", "y"])], "a array<string>, b array<string>")
    (r,) = df.select(vis.merge_observations(F.col("a"), F.col("b")).alias("m")).collect()
    assert r.m == ["x", "[Python] y", "[Python] y"]
