"""Indicators over time against plain Python, and sketches against exact figures."""

import random
import statistics
from datetime import datetime, timedelta

import pytest

from votecount.plans import indicators as ind

DAY = datetime(2025, 8, 17)
EVENTS = "acta_id string, tipo_evento string, fecha timestamp, event_id long"


def test_state_as_of_takes_ties_by_number_and_late_events_by_time(spark):
    at = lambda h: DAY + timedelta(hours=h)
    rows = [("a", "E1", at(1), 5), ("a", "E2", at(1), 6), ("a", "E4", at(4), 1), ("b", "E3", at(3), 9),
            (None, "E5", at(1), 2), ("c", "E6", None, 3)]
    got = ind.state_as_of(spark.createDataFrame(rows, EVENTS), [at(1), at(0), at(3), at(4), at(4)])
    states = {(r.acta_id, r.momento): (r.ultimo_evento, r.eventos) for r in got.collect()}
    assert states == {
        ("a", at(1)): ("E2", 2), ("a", at(3)): ("E2", 2), ("a", at(4)): ("E4", 3),
        ("b", at(3)): ("E3", 1), ("b", at(4)): ("E3", 1),
        (None, at(1)): ("E5", 1), (None, at(3)): ("E5", 1), (None, at(4)): ("E5", 1),
    }
    assert got.count() == len(states)


def test_state_as_of_of_nothing(spark):
    assert ind.state_as_of(spark.createDataFrame([], EVENTS), [DAY]).collect() == []


def test_robust_outliers_against_plain_medians(spark):
    draw = random.Random(3)
    values = [("Beni", i, 1000, draw.randint(600, 800)) for i in range(301)] + [("Beni", 301, 1000, 10)]
    flat = [("Pando", 400 + i, 100, 50) for i in range(9)] + [("Pando", 410, 100, 99), ("Oruro", 500, 0, 7)]
    df = spark.createDataFrame(
        values + flat, "departamento string, codigo_acta long, votantes_habilitados long, papeletas_anfora long"
    )
    turnout = [v * 10 for *_, v in values]
    middle = statistics.median(turnout)
    mad = statistics.median(abs(x - middle) for x in turnout)
    want = {i: round(0.6745 * (x - middle) / mad, 4) for i, x in enumerate(turnout) if abs(0.6745 * (x - middle) / mad) > 3.5}
    got = {r.codigo_acta: r.puntaje for r in ind.turnout_outliers_robust(df).collect()}
    assert 301 in got and got == pytest.approx(want)


def test_made_up_last_digits_are_told(spark):
    draw = random.Random(5)
    honest = [(1, *(draw.randint(10, 999) for _ in range(4))) for _ in range(100)]
    rounded = [(2, *(draw.randint(1, 99) * 10 + 5 for _ in range(4))) for _ in range(100)]
    few = [(3, 10, 20, None, 5)]
    df = spark.createDataFrame(honest + rounded + few, "codigo_recinto long, P1 long, P2 long, P3 long, P4 long")
    got = {r.codigo_recinto: r for r in ind.digit_test(df).collect()}
    assert set(got) == {1, 2} and got[1].cifras == 400
    assert not got[1].sospechoso and got[2].sospechoso
    counts = [sum(v % 10 == d for row in honest for v in row[1:]) for d in range(10)]
    assert got[1].chi2 == pytest.approx(sum((o - 40) ** 2 / 40 for o in counts), abs=1e-6)


@pytest.fixture(scope="module")
def arrivals(spark):
    """Sheets of three days, closed at 16; every tenth is received before."""
    draw = random.Random(7)
    rows = []
    for k in range(30_000):
        hour = draw.uniform(10, 16) if k % 10 == 0 else draw.triangular(16, 24, 17)
        rows.append((f"MESA-{k}", "Beni", DAY + timedelta(days=k % 3, seconds=int(hour * 3600 - 1))))
    sheets = spark.createDataFrame(rows, "acta_id string, departamento string, fecha_recepcion timestamp")
    tables = spark.range(30_000).selectExpr("id codigo_acta", "'16' cierre_hora", "id % 7000 codigo_recinto")
    return rows, sheets.cache(), tables.cache()


def test_merged_quantiles_are_within_the_rank_error(arrivals):
    rows, sheets, tables = arrivals
    days = {}
    for _, _, t in rows:
        late = (t - t.replace(hour=0, minute=0, second=0)).total_seconds() - 16 * 3600
        if late >= 0:
            days.setdefault(t.date(), []).append(late)
    parts = ind.latency_parts(sheets, tables)
    assert parts.count() > 20
    exact = {r.inicio.date(): r for r in ind.latency_exact(sheets, tables, "1 day").collect()}
    merged = ind.latency_of_parts(parts).collect()
    assert {r.inicio.date() for r in merged} == set(days) == set(exact)
    for r in merged:
        known = sorted(days[r.inicio.date()])
        assert r.actas == len(known) == exact[r.inicio.date()].actas
        assert exact[r.inicio.date()].p50 == statistics.median(known)
        for q, value in ((0.5, r.p50), (0.95, r.p95)):
            below = sum(x < value for x in known) / len(known)
            upto = sum(x <= value for x in known) / len(known)
            assert below - 0.03 <= q <= upto + 0.03


def test_merged_places_are_within_the_error(arrivals):
    rows, sheets, tables = arrivals
    parts = ind.active_place_parts(sheets, tables)
    got = {r.inicio: r.recintos for r in ind.active_places_of_parts(parts).collect()}
    want = {r.inicio: r.recintos for r in ind.active_places(sheets, tables, "1 day").collect()}
    plain = {}
    for code, _, t in rows:
        plain.setdefault(t.replace(hour=0, minute=0, second=0), set()).add(int(code[5:]) % 7000)
    assert want == {day: len(places) for day, places in plain.items()}
    assert set(got) == set(want)
    assert all(abs(got[d] - want[d]) <= 0.05 * want[d] for d in want)


def test_places_of_a_stream_equal_the_batch(spark, arrivals, tmp_path):
    _, sheets, tables = arrivals
    sheets.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sheets.schema).parquet(str(tmp_path / "in"))
    run = (
        ind.active_place_parts(stream, tables, watermark="7 days")
        .writeStream.format("memory").queryName("place_parts").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    got = {r.inicio: r.recintos for r in ind.active_places_of_parts(spark.table("place_parts")).collect()}
    want = {r.inicio: r.recintos for r in ind.active_places_of_parts(ind.active_place_parts(sheets, tables)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[d] - want[d]) <= 0.02 * want[d] for d in want)
