"""Uploads, messages and corrections in one store."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_sms import POLICY, T0, crowd, frame
from votecount import schemas
from votecount.functions.visual import merge_visual, preprocess_flags, visual_flags
from votecount.operators import images
from votecount.operators import machine as m
from votecount.operators.events import upload_events
from votecount.plans.snapshot import long_snapshot, project_snapshot
from votecount.sources.adapter import Election
from votecount.sources.sinks import read_snapshot
from votecount.streaming import sms_stream as ss
from votecount.streaming import store as st

SF = "/root/testdata/sf0.001"


def _keys(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def uploads(spark, tmp_path_factory):
    """Files of the small election with their image's flags, kept once as a table."""
    path = str(tmp_path_factory.mktemp("uploads"))
    e = Election(spark, SF)
    flags = merge_visual(visual_flags(e.measurements), preprocess_flags(e.cleaned, e.cells))
    per_file = e.parsed_files.select("hash_origen", "acta_id").distinct().join(flags, "acta_id").drop("acta_id")
    images.with_images(e.parsed_files, per_file).where("k % 3 = 0").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), e


def test_stream_of_uploads_equals_the_batch(spark, uploads, tmp_path):
    files, e = uploads
    inbox = str(tmp_path / "in")
    cuts = files.selectExpr("percentile(unix_micros(fecha_recepcion), array(0.4))").first()[0]
    early = F.expr(f"unix_micros(fecha_recepcion) <= {cuts[0]}")
    files.where(early).coalesce(1).write.parquet(inbox)
    files.where(~early).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    store = ss.Store(str(tmp_path / "store"))
    printed = e.mesas
    query = ss.run_upload_stream(stream, store, e.reference, str(tmp_path / "cp"), printed)
    query.awaitTermination(400)
    assert query.exception() is None
    batch = m.upload_outcomes(files, e.reference).persist()
    kept = batch.where(F.col("resultado") == m.STORED)
    sheets = store.current_sheets(spark)
    columns = ("acta_id", "hash_origen", "estado", "motivo_estado", "votos_validos")
    assert _keys(sheets, *columns) == _keys(kept, *columns)
    assert {r.estado for r in sheets.select("estado").distinct().collect()} >= {"ANULADA", "PROCESADA"}
    events = ("seq", "paso", "tipo_evento", "acta_id")
    assert _keys(store.read(spark, store.events), *events) == _keys(upload_events(batch), *events)
    fresh = batch.where(F.col("resultado") != m.SAME_FILE)
    issues = ("acta_id", "tipo", "descripcion")
    assert _keys(store.read(spark, store.inconsistencies), *issues) == _keys(m.issues_of(fresh), *issues)
    wanted = project_snapshot(kept, printed, m.issues_of(fresh))
    got = read_snapshot(spark, store.snapshot)
    assert _keys(got, *wanted.columns) == _keys(wanted, *wanted.columns)
    # The same files once more: what was stored is known by its hash, the rest by its id.
    before = sheets.count()
    ss.process_uploads(files, 2, store, e.reference)
    assert store.current_sheets(spark).count() == before
    again = store.read(spark, store.events).where("lote = 2 AND canal = 'UPLOAD'")
    assert "ACTA_GUARDADA" not in {r.tipo_evento for r in again.collect()}
    batch.unpersist()


def test_messages_and_uploads_know_each_other(spark, uploads, tmp_path):
    files, e = uploads
    store = ss.Store(str(tmp_path / "store"))
    few = files.where("copia = 0 AND k < 60")
    sheets = [r.acta_id for r in few.collect()]
    text = f"ACTA:{sheets[0]}|DEP:La Paz|MUN:El Alto|REC:Uno|MESA:1|VAL:6|NUL:1|BLA:1|C1:1|C2:2|C3:3|C4:0|PIN:{POLICY.pin}"
    ss.process_batch(frame(spark, [(POLICY.phones[0], text)]), 0, store, POLICY)
    assert [r.acta_id for r in store.current_sheets(spark).collect()] == [sheets[0]]
    for _ in range(2):  # a repeated batch takes effect once
        ss.process_uploads(few, 0, store, e.reference)
    stored = store.current_sheets(spark)
    assert stored.count() == stored.select("acta_id").distinct().count() == len(set(sheets))
    log = store.read(spark, store.events).where("canal = 'UPLOAD' AND acta_id = '%s'" % sheets[0])
    assert "DUPLICADO_DETECTADO" in {r.tipo_evento for r in log.collect()}
    # A message for a sheet that came as a file is a duplicate too.
    other = text.replace(sheets[0], sheets[1])
    ss.process_batch(frame(spark, [(POLICY.phones[0], other)]), 1, store, POLICY)
    last = store.read(spark, store.register).where("lote = 1").collect()
    assert [r.estado for r in last] == ["DUPLICADO"]


def test_a_file_is_found_by_its_hash_under_another_id(spark, uploads, tmp_path):
    files, e = uploads
    store = ss.Store(str(tmp_path / "store"))
    one = files.where("copia = 0").limit(1)
    ss.process_uploads(one, 0, store, e.reference)
    renamed = one.withColumn("acta_id", F.lit("MESA-9")).withColumn("seq", F.col("seq") + 1)
    known = store.known(renamed, 1, ss.UPLOAD)
    assert [r.acta_id for r in known.collect()] == [one.first().acta_id]
    ss.process_uploads(renamed, 1, store, e.reference)
    assert store.current_sheets(spark).count() == 1


def test_snapshot_equals_recomputation_after_corrections(spark, tmp_path):
    store = ss.Store(str(tmp_path / "store"))
    printed = spark.createDataFrame([(1, 100)], "codigo_acta long, votantes_habilitados long")
    ss.process_batch(frame(spark, crowd(40, 3)), 0, store, POLICY, printed=printed)
    good = [r.acta_id for r in store.current_sheets(spark).where("estado = 'PROCESADA'").collect()]
    assert len(good) >= 3
    change = lambda *rows: spark.createDataFrame(list(rows), "acta_id string, estado string, motivo_estado string")
    lots = [
        change((good[0], "ANULADA", "TEXTO_ANULADA"), (good[1], "OBSERVADA", ""), ("MESA-none", "ANULADA", "")),
        change((good[0], "PROCESADA", ""), (good[1], "ANULADA", ""), (good[2], "PROCESADA", "")),
    ]
    for n, rows in enumerate(lots):
        for _ in range(2):
            ss.process_corrections(rows, n, store, printed)
    current = store.current_sheets(spark)
    assert {r.acta_id: r.estado for r in current.where(F.col("acta_id").isin(good[:3])).collect()} == {
        good[0]: "PROCESADA", good[1]: "ANULADA", good[2]: "PROCESADA"}
    assert current.count() == current.select("acta_id").distinct().count()
    wanted = project_snapshot(current, printed, store.read(spark, store.inconsistencies))
    got = read_snapshot(spark, store.snapshot)
    assert _keys(got, *wanted.columns) == _keys(wanted, *wanted.columns)
    counts = long_snapshot(current, store.read(spark, store.inconsistencies))
    assert _keys(store.total(spark).where("cantidad <> 0"), "grupo", "clave", "cantidad") == _keys(
        counts.where("cantidad <> 0"), "grupo", "clave", "cantidad")


def _rows(spark, n):
    return spark.createDataFrame([(f"h{n}", f"MESA-{n}")], "hash_origen string, acta_id string")


def test_lots_are_merged_and_every_row_is_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MERGE", 3)
    store = ss.Store(str(tmp_path / "store"))
    for n in range(20):
        store.write(_rows(spark, n), store.hashes, n, key="hash_origen")
        store.write(_rows(spark, n), store.events, n)
        store.merge(spark, n, ss.SMS)
        if n in (2, 8, 13):  # the same batch again, as after a failure
            assert sorted(r.acta_id for r in store.read(spark, store.hashes, n).collect()) == sorted(f"MESA-{i}" for i in range(n))
            store.write(_rows(spark, n), store.hashes, n, key="hash_origen")
            store.merge(spark, n, ss.SMS)
    for path in (store.hashes, store.events):
        got = store.read(spark, path)
        assert sorted((r.acta_id, r.lote) for r in got.collect()) == sorted((f"MESA-{n}", n) for n in range(20))
        parts = st._cover(spark, f"{path}/canal=SMS", f"{path}-runs/canal=SMS", None)
        assert parts == [(0, 8), (9, 17), (18, 18), (19, 19)]
    assert st._lots(spark, f"{store.hashes}/canal=SMS") == [18, 19]


def test_a_total_is_read_from_one_file_however_many_batches(spark, tmp_path):
    store = ss.Store(str(tmp_path / "store"))
    delta = spark.createDataFrame([("estado", "PROCESADA", 2), ("estado", "ERROR", 1)], "grupo string, clave string, cantidad long")
    sizes = []
    for n in range(20):
        store.add_to_totals(delta, n, ss.SMS)
        if n == 7:
            store.add_to_totals(delta, n, ss.SMS)
        sizes.append((len(store.total(spark).inputFiles()), len(st._lots(spark, f"{store.totals}/canal=SMS"))))
    assert {f for f, _ in sizes} == {1} and max(n for _, n in sizes) == 2
    assert _keys(store.total(spark), "clave", "cantidad") == [("ERROR", 20), ("PROCESADA", 40)]


def test_half_written_lots_are_not_read(spark, tmp_path):
    store = ss.Store(str(tmp_path / "store"))
    for n in range(2):
        store.write(_rows(spark, n), store.events, n)
    (tmp_path / "store/events/canal=SMS/lote=1/_SUCCESS").unlink()
    assert [r.acta_id for r in store.read(spark, store.events).collect()] == ["MESA-0"]


# --- images on a stream ---------------------------------------------------------------

FILES = "seq long, file_name string, hash_origen string, fecha_recepcion timestamp"
FLAGS = "hash_origen string, medida_en timestamp, lapiz_detectado boolean, firmas_suficientes boolean"


def test_files_wait_for_their_measurement(spark, tmp_path):
    at = lambda minutes: datetime(2026, 5, 3, 8) + timedelta(minutes=minutes)
    steps = [
        ([(1, "a.pdf", "h1", at(0)), (2, "b.pdf", "h2", at(0)), (3, "c.jpg", "h3", at(0)), (4, "d.pdf", "h4", at(0))], [("h1", at(1), True, True)]),
        # h2 comes late but in time; h3 is no PDF; h4's comes after its limit.
        ([(5, "e.pdf", "h5", at(60))], [("h2", at(25), False, False), ("h3", at(2), True, True), ("h4", at(50), True, True)]),
        ([(6, "f.pdf", "h6", at(300))], [("h5", at(61), True, True), ("x", at(300), True, True)]),
        ([(7, "g.pdf", "h7", at(301))], [("y", at(301), True, True)]),
    ]
    files, flags, out = str(tmp_path / "files"), str(tmp_path / "flags"), str(tmp_path / "out")
    for new_files, new_flags in steps:
        spark.createDataFrame(new_files, FILES).coalesce(1).write.mode("append").parquet(files)
        spark.createDataFrame(new_flags, FLAGS).coalesce(1).write.mode("append").parquet(flags)
        stream = images.join_images(spark.readStream.schema(FILES).parquet(files), spark.readStream.schema(FLAGS).parquet(flags))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(out)
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.schema(stream.schema).parquet(out).select("seq", "validacion_visual.lapiz_detectado", "validacion_visual").collect()
    got = {r.seq: None if r.validacion_visual is None else r.lapiz_detectado for r in rows}
    assert len(rows) == len(got)
    assert {k: got[k] for k in (1, 2, 3, 4, 5)} == {1: True, 2: False, 3: None, 4: None, 5: True}
    assert not {6, 7} & got.keys()  # still waiting


def test_batch_takes_the_flags_of_its_own_files(spark):
    files = spark.createDataFrame([(1, "a.pdf", "h1", T0), (2, "b.pdf", "h2", T0), (3, "c.jpg", "h1", T0), (4, "d.pdf", None, T0)], FILES)
    flags = spark.createDataFrame([("h1", True)], "hash_origen string, lapiz_detectado boolean")
    got = images.with_images(files, flags)
    assert got.schema["validacion_visual"].dataType == schemas.VISUAL
    assert {r.seq: r.validacion_visual and r.validacion_visual.lapiz_detectado for r in got.collect()} == {1: True, 2: None, 3: None, 4: None}
