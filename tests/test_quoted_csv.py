"""Files that are cut between and within quoted values."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from votecount.sources import quoted_csv as qc
from votecount.sources import readers as rd


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "300")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(n, seed=1):
    rnd = random.Random(seed)
    notes = ["", "plain", 'says "no", twice', "two\nlines", "a,b", '"', '\n\n,"\n', "x" * 700 + "\n" + "y" * 700, "CodigoActa ilegible"]
    return [[str(100 + i), str(rnd.randint(1, 9)), rnd.choice(notes), str(i)] for i in range(n)]


def _write(path, header, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


HEADER = ["CodigoActa", "NroMesa", "Observaciones", "P1"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_over_many_splits_gives_the_rows_of_the_whole_file(spark, tmp_path, small_splits, end):
    rows = _rows(400)
    _write(tmp_path / "t.csv", HEADER, rows, end)
    df = rd.read_transcriptions(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got = sorted((r.codigo_acta, r.nro_mesa, r.observaciones, r.p1) for r in df.collect())
    assert got == sorted((int(a), int(b), c.strip(), int(d)) for a, b, c, d in rows)
    whole = spark.read.option("header", True).options(multiLine=True, **qc.OPTIONS).csv(str(tmp_path))
    raw = rd._csv(spark, str(tmp_path))
    assert sorted(map(tuple, raw.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_more_crossed_cuts_than_are_sent(spark, tmp_path, small_splits, monkeypatch):
    rows = _rows(200, seed=4)
    _write(tmp_path / "t.csv", HEADER, rows)
    monkeypatch.setattr(qc, "SENT", 0)
    got = rd.read_transcriptions(spark, str(tmp_path)).collect()
    assert sorted((r.codigo_acta, r.observaciones) for r in got) == sorted((int(a), c.strip()) for a, _, c, _ in rows)


def test_large_and_small_files_with_columns_in_any_order(spark, tmp_path, small_splits):
    rows = _rows(60)
    _write(tmp_path / "a.csv", HEADER, rows)
    _write(tmp_path / "b c.csv", ["P1", "CodigoActa", "Extra"], [["7", "9", "z"]])
    _write(tmp_path / "d.csv", ["Observaciones", "", "CodigoActa"], [["n\nm", "", str(1000 + i)] for i in range(80)])
    got = {r.codigo_acta: (r.p1, r.observaciones) for r in rd.read_transcriptions(spark, str(tmp_path)).collect()}
    wanted = {int(a): (int(d), c.strip()) for a, _, c, d in rows} | {9: (7, "")} | {1000 + i: (0, "n\nm") for i in range(80)}
    assert got == wanted


def test_a_line_that_names_a_column_is_no_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("CodigoActa,Observaciones\n101,CodigoActa ilegible\n102,\n")
    assert sorted(r.codigo_acta for r in rd.read_transcriptions(spark, str(tmp_path)).collect()) == [101, 102]


@pytest.mark.parametrize("content", ["", "CodigoActa,NroMesa\n", "\n", "CodigoActa"])
def test_files_without_rows(spark, tmp_path, content):
    (tmp_path / "t.csv").write_text("CodigoActa,P1\n5,6\n")
    (tmp_path / "u.csv").write_text(content)
    assert [(r.codigo_acta, r.p1) for r in rd.read_transcriptions(spark, str(tmp_path)).collect()] == [(5, 6)]


field = st.text('ab",\n ', max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(field, min_size=2, max_size=3), min_size=1, max_size=5))
def test_line_ends_within_quotes(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    inside, count = False, 0
    for line in out.getvalue()[:-1].split("\n"):
        inside = qc.inside_after(line, inside)
        count += not inside
    assert not inside and count == len(rows)


def test_stray_quotes_do_not_swallow_lines():
    assert not qc.inside_after('5" pipe,x', False)
    assert not qc.inside_after('x,5"', False)
    assert qc.inside_after('x,"5', False)
    assert not qc.inside_after('"a\\",c', False)
    assert not qc.inside_after('end"tail,x', True)


def test_names_of_columns():
    assert qc.columns_of("﻿a,,a,b c") == ["a0", "_c1", "a2", "b c"]
