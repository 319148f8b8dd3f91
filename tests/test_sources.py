"""Files in, stores out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from votecount.sources import readers as rd
from votecount.sources import sinks as sk


def test_territory_by_header_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("CodigoTerritorial,Departamento,Municipio,Provincia\n1,Beni, Trinidad ,Cercado\n,,,\n")
    (r,) = rd.read_territory(spark, str(path)).collect()
    assert (r.codigo_territorial, r.departamento, r.provincia, r.municipio) == (1, "Beni", "Cercado", "Trinidad")


def test_precincts(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("RecintoNombre,recintoCode,CodigoTerritorial,CodigoRecinto,RecintoDireccion,NumMesas\n"
                    '"Sol, Norte",R1,1,10,Calle 5,3\n')
    (r,) = rd.read_precincts(spark, str(path)).collect()
    assert (r.codigo_recinto, r.recinto, r.num_mesas) == (10, "Sol, Norte", 3)


CSV = """CodigoActa,CodigoRecinto,NroMesa,VotantesHabilitados,P1,P2,P3,P4,VotosValidos,VotosBlancos,VotosNulos,PapeletasAnfora,PapeltasNoUtilizadas,AperturaHora,AperturaMinutos,CierreHora,CierreMinutos,Observaciones,
1010200001001,10,1,20,12abc,2,x,-4,10,1,1,12,8,0,5,,3, corre y vale ,

,10,2,20,1,2,3,4,10,1,1,12,8,9,0,17,0,sin codigo,
1010200001002,10,3,20,1,2
"""


def test_lenient_transcriptions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    a, b = rd.read_transcriptions(spark, str(path)).orderBy("codigo_acta").collect()
    assert (a.p1, a.p2, a.p3, a.p4) == (12, 2, 0, -4)
    assert (a.apertura_hora, a.apertura_minutos, a.cierre_hora, a.cierre_minutos) == (8, 5, 16, 3)
    assert a.observaciones == "corre y vale"
    assert (b.p1, b.p2, b.votos_validos, b.cierre_hora, b.observaciones) == (1, 2, 0, 16, "")


def test_other_header_spelling(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("CodigoActa,PapeletasEnAnfora,PapeletasNoUtilizadas\n7,12,8\n")
    (r,) = rd.read_transcriptions(spark, str(path)).collect()
    assert (r.papeletas_anfora, r.papeletas_no_utilizadas) == (12, 8)


def test_mesas_read_four_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    df = rd.read_mesas(spark, str(path))
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "NroMesa" in schema and "P1" not in schema and "Observaciones" not in schema


def test_files_of_one_folder_order_their_columns_as_they_like(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('CodigoActa,NroMesa,P1,Observaciones\n1,2,3,"one\nnote, two lines"\n')
    (tmp_path / "b.csv").write_text("P1,CodigoActa,P2\n30,10,40\n31,11,41\n")
    (tmp_path / "c.csv").write_text("P1,CodigoActa,P2\n32,12,42\n")
    got = {r.codigo_acta: r for r in rd.read_transcriptions(spark, str(tmp_path)).collect()}
    assert {k: (r.nro_mesa, r.p1, r.p2) for k, r in got.items()} == {
        1: (2, 3, 0), 10: (0, 30, 40), 11: (0, 31, 41), 12: (0, 32, 42)}
    assert got[1].observaciones == "one\nnote, two lines"


def test_texts_and_inventory(spark, tmp_path):
    (tmp_path / "acta_1.txt").write_text("uno\ndos")
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"xyz")
    (r,) = rd.read_sheet_texts(spark, str(tmp_path / "*.txt")).collect()
    assert (r.file_name, r.text) == ("acta_1.txt", "uno\ndos")
    (f,) = rd.file_inventory(rd.read_files(spark, str(tmp_path / "*.[pP]*"))).collect()
    assert (f.file_name, f.extension, f.bytes) == ("b.pdf", ".pdf", 3)
    assert f.hash_origen == hashlib.sha256(b"xyz").hexdigest()


def register(spark, *rows):
    return spark.createDataFrame(list(rows), "seq long, hash_mensaje string, acta_id string")


def test_append_sms_loses_repeats_silently(spark, tmp_path):
    path = str(tmp_path / "sms")
    sk.append_sms(register(spark, (1, "a", "x"), (2, "a", "y")), path, F.col("seq"))
    sk.append_sms(register(spark, (3, "a", "z"), (4, "b", "w")), path, F.col("seq"))
    got = spark.read.parquet(path).orderBy("seq").collect()
    assert [(r.seq, r.acta_id) for r in got] == [(1, "x"), (4, "w")]


def arriving(spark, *rows):
    df = spark.createDataFrame(list(rows), "seq long, acta_id string, hash_origen string")
    return df.withColumn("fecha_recepcion", F.timestamp_seconds("seq"))


@pytest.mark.parametrize("calls", [[3], [1, 2], [1, 1, 1]])
def test_a_refused_sheet_does_not_stand_in_the_way(spark, tmp_path, calls):
    rows = [(1, "A", "h1"), (2, "B", "h1"), (3, "B", "h2")]
    path = str(tmp_path / "sheets")
    for n in calls:
        sk.append_sheets(arriving(spark, *rows[:n]), path)
        rows = rows[n:]
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [1, 3]


def test_append_sheets_needs_new_id_and_new_hash(spark, tmp_path):
    path = str(tmp_path / "sheets")
    df = lambda *rows: arriving(spark, *rows)
    sk.append_sheets(df((1, "A", "h1"), (2, "A", "h2"), (3, "B", "h1")), path)
    sk.append_sheets(df((4, "C", "h1"), (5, "A", "h9"), (6, "D", "h6")), path)
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [1, 6]


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert sk.read_snapshot(spark, root) is None
    for n in (1, 2):
        sk.write_snapshot(spark.range(n, n + 1), root, n)
    sk.write_snapshot(spark.range(2, 3), root, 2)
    (tmp_path / "snap" / "version=9").mkdir()
    (r,) = sk.read_snapshot(spark, root).collect()
    assert r.id == 2 and r.ultima_actualizacion is not None


def test_official_write_is_repeatable_and_truncates(spark, tmp_path):
    sheets, votes = str(tmp_path / "s"), str(tmp_path / "v")
    row = spark.createDataFrame([(7, 1, 2, 3, 4, 10)],
                                "codigo_acta long, p1 long, p2 long, p3 long, p4 long, votos_validos long")
    for _ in range(2):
        sk.write_official(row, sheets, votes, "1")
    assert spark.read.parquet(sheets).count() == 1
    got = spark.read.parquet(votes).orderBy("id_partido").collect()
    assert [(r.id_partido, r.cantidad_votos) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    sk.truncate_official(spark, sheets, votes)
    assert spark.read.parquet(sheets).count() == spark.read.parquet(votes).count() == 0
    assert "votos_validos" in spark.read.parquet(sheets).columns


def test_seed_and_migrate_only_once(spark, tmp_path):
    path = str(tmp_path / "m")
    for n in (1, 2):
        sk.migrate(spark.range(n).withColumn("_id", F.lit("x")), path)
    got = spark.read.parquet(path)
    assert got.columns == ["id"] and got.count() == 1
