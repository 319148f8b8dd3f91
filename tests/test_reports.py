"""Corner cases of the question bank, dashboard, snapshot and replay."""

from datetime import datetime

import pytest

from votecount.plans import dashboard as dash
from votecount.plans import query_bank as qb
from votecount.plans import replay as rep
from votecount.plans import snapshot as snap

WIDE = ("departamento string, provincia string, municipio string, recinto string, codigo_acta long, nro_mesa int, "
        "votantes_habilitados long, papeletas_anfora long, P1 long, P2 long, P3 long, P4 long, "
        "votos_validos long, votos_blancos long, votos_nulos long")


@pytest.fixture(scope="module")
def wide(spark):
    rows = [
        ("Beni", "P", "M1", "Sol", 1, 1, 100, 80, 10, 20, 30, 20, 80, 0, 0),
        ("Beni", "P", "M1", "Luna", 2, 1, 100, 79, 10, 20, 30, 19, 79, 0, 4),
        ("Pando", "Q", "M2", "Sol", 3, 1, 0, 5, 5, None, 0, 0, 0, 2, 3),
    ]
    return spark.createDataFrame(rows, WIDE)


def test_null_part_contributes_nothing(wide):
    got = {r.departamento: r.total_votos for r in qb.votes_by_department(wide).collect()}
    assert got == {"Beni": 159, "Pando": 0}


def test_same_name_merges_in_top_but_not_in_count(wide):
    assert [(r.recinto, r.votos) for r in qb.top_precincts(wide, "P1", 1).collect()] == [("Sol", 15)]
    assert qb.mesas_per_precinct(wide).count() == 3
    with pytest.raises(ValueError):
        qb.top_precincts(wide, "P9")


def test_no_valid_votes_and_no_voters(wide):
    nulls = {r.departamento: r.porcentaje_nulos for r in qb.null_votes_by_department(wide).collect()}
    assert nulls["Pando"] == 0.0
    turnout = {r.departamento: r.participacion_pct for r in qb.turnout_by_department(wide).collect()}
    assert turnout["Pando"] == 0.0


def test_exactly_the_threshold_is_not_above_it(wide):
    assert [r.codigo_acta for r in qb.high_abstention(wide).collect()] == [2]
    assert [r.codigo_acta for r in qb.high_abstention(wide, -1).collect()] == [2]


def test_province_wins_over_the_other_filters(wide):
    (r,) = qb.geo_results(wide, department="Pando", municipality="M2", province="P").collect()
    assert (r.geo, r.P1) == ("P", 20)
    assert {r.geo for r in qb.geo_results(wide, municipality="M1").collect()} == {"Sol", "Luna"}


SHEETS = "acta_id string, departamento string, estado string, votos_validos long, fecha_recepcion timestamp"


def test_department_gap_keeps_quick_departments_only(spark, wide):
    t = datetime(2025, 8, 17)
    quick = spark.createDataFrame([("a", "Beni", "ERROR", 100, t), ("b", "Oruro", "PROCESADA", 7, t)], SHEETS)
    got = {r.departamento: (r.oficial_votos_validos, r.diferencia_votos) for r in qb.department_gap(quick, wide).collect()}
    assert got == {"Beni": (159, -59), "Oruro": (0, 7)}


def muni(spark, *rows):
    return spark.createDataFrame(
        list(rows), "Departamento string, Municipio string, VantantesHabilitados long".replace("Vantantes", "Votantes")
        + ", VotosValidos long, VotosBlancos long, VotosNulos long, P1 long, P2 long, P3 long, P4 long")


def test_turnout_rounds_half_to_even_and_ties_go_to_the_first(spark):
    df = muni(spark, ("A", "m", 400, 41, 0, 0, 1, 5, 5, 0), ("B", "m", 0, 9, 0, 0, 0, 0, 0, 0))
    a, b = dash.with_winner(df).orderBy("Departamento").collect()
    assert (a.Participacion, a.GanadorCodigo, a.VotosGanador) == (10.2, "P2", 5)
    assert (b.Participacion, b.GanadorCodigo) == (0.0, "P1")


def test_unknown_departments_have_no_point(spark):
    df = muni(spark, ("Beni", "m", 1, 1, 0, 0, 1, 0, 0, 0), ("Exterior", "m", 1, 1, 0, 0, 1, 0, 0, 0))
    assert [r.Departamento for r in dash.with_centroids(df, "P1").collect()] == ["Beni"]


def full_sheets(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "estado string, departamento string, tipo_entrada string, votos_validos long, votos_nulos long, "
        "votos_blancos long, candidatos array<struct<candidato_id:string,votos:long>>")


@pytest.mark.parametrize(
    "candidates, margin",
    [([("C1", 60), ("C2", 40)], 20.0), ([("C1", 50), ("C2", 50)], 0.0), ([("C1", 100)], 0.0)])
def test_margin(spark, candidates, margin):
    sheets = full_sheets(spark, ("PROCESADA", "Beni", "PDF", 100, 0, 0, candidates),
                         ("ERROR", "", "SMS", 900, 0, 0, [("C9", 900)]))
    printed = spark.createDataFrame([(1, 400)], "codigo_acta long, votantes_habilitados long")
    none = spark.createDataFrame([], "tipo string")
    (r,) = snap.project_snapshot(sheets, printed, none).collect()
    assert r.margen_victoria == margin
    assert (r.porcentaje_avance, r.tasa_participacion, r.total_inconsistencias) == (200.0, 25.0, 0)
    parts = {(p.grupo, p.clave): p.cantidad for p in snap.breakdown(sheets).collect()}
    assert ("departamento", "") not in parts and ("candidato", "C9") not in parts


def test_snapshot_of_nothing(spark):
    printed = spark.createDataFrame([], "codigo_acta long, votantes_habilitados long")
    none = spark.createDataFrame([], "tipo string")
    (r,) = snap.project_snapshot(full_sheets(spark), printed, none).collect()
    assert (r.total_actas_procesadas, r.margen_victoria, r.porcentaje_avance) == (0, 0.0, 0.0)


def test_replay_of_one_sheet(spark):
    t = lambda h: datetime(2025, 8, 17, h)
    events = spark.createDataFrame([("a", "E1", t(1)), ("a", "E3", t(3)), ("b", "E9", t(1))],
                                   "acta_id string, tipo_evento string, fecha timestamp")
    issues = spark.createDataFrame([("a", "X", t(2))], "acta_id string, tipo string, fecha timestamp")
    sheets = spark.createDataFrame([("a", "PROCESADA", t(4))], "acta_id string, estado string, fecha_recepcion timestamp")
    assert [r.detalle for r in rep.replay(events, issues, sheets, "a").collect()] == ["E1", "X", "E3", "PROCESADA"]
    counts = {r.acta_id: (r.total_eventos, r.total_inconsistencias, r.estado_actual)
              for r in rep.replay_counts(events, issues, sheets).collect()}
    assert counts == {"a": (2, 1, "PROCESADA"), "b": (1, 0, None)}


def test_small_scans_are_pruned(spark):
    """The flagship query reads only what it needs from its widest table."""
    from votecount.registry import QUERIES

    df = QUERIES["q03_votes_by_department"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = [s.split("\n")[0] for s in plan.split("ReadSchema: ")[1:]]
    lines = [s for s in schemas if "l_orderkey" in s]
    assert lines == ["struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>"]
