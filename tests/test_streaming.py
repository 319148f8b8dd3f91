"""Streams give what a batch over the same rows gives."""

from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_sms import POLICY, T0, crowd, frame
from votecount import schemas
from votecount.operators import machine as m
from votecount.operators.events import sms_events
from votecount.plans.replay import arrivals, latest_state
from votecount.sources.readers import stream_sms
from votecount.sources.sinks import read_snapshot
from votecount.streaming import sms_stream as ss
from votecount.streaming import views


def _drop_files(spark, messages, folder, parts):
    """One file per stretch of arrivals, in order."""
    step = -(-len(messages) // parts)
    rows = [(p, t, T0 + timedelta(minutes=i), i) for i, (p, t) in enumerate(messages)]
    for n in range(parts):
        piece = rows[n * step:(n + 1) * step]
        spark.createDataFrame(piece, schemas.SMS_MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def _keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stream_equals_batch(spark, tmp_path):
    messages = crowd(60, 11)
    inbox = str(tmp_path / "in")
    _drop_files(spark, messages, inbox, 3)
    store = ss.Store(str(tmp_path / "store"))
    printed = spark.createDataFrame([(1, 100), (2, 100)], "codigo_acta long, votantes_habilitados long")
    query = ss.run_sms_stream(stream_sms(spark, inbox, files_per_batch=1), store, POLICY,
                              str(tmp_path / "cp"), printed=printed)
    query.awaitTermination(300)
    assert query.exception() is None
    batch = m.sms_outcomes(frame(spark, messages), POLICY)
    register = store.read(spark, store.register)
    assert register.select("lote").distinct().count() == 3
    assert _keys(register, "seq", "estado", "acta_id") == _keys(m.sms_register(batch), "seq", "estado", "acta_id")
    sheets = store.read(spark, store.sheets)
    assert _keys(sheets, "seq", "acta_id", "estado") == _keys(m.sms_sheets(batch), "seq", "acta_id", "estado")
    events = ("seq", "paso", "tipo_evento", "acta_id")
    assert _keys(store.read(spark, store.events), *events) == _keys(sms_events(batch), *events)
    issues = ("acta_id", "tipo", "descripcion")
    assert _keys(store.read(spark, store.inconsistencies), *issues) == _keys(m.issues_of(batch), *issues)
    (snapshot,) = read_snapshot(spark, store.snapshot).collect()
    assert snapshot.total_actas_esperadas == 2
    good = sheets.where("estado = 'PROCESADA'")
    assert snapshot.total_actas_procesadas == good.count()
    assert snapshot.total_inconsistencias == store.read(spark, store.inconsistencies).count()


def test_a_repeated_batch_takes_effect_once(spark, tmp_path):
    store = ss.Store(str(tmp_path / "store"))
    first, second = crowd(30, 5), crowd(30, 6)
    ss.process_batch(frame(spark, first), 0, store, POLICY)
    for _ in range(2):
        ss.process_batch(frame(spark, second), 1, store, POLICY)
    register = store.read(spark, store.register)
    assert register.count() == len({t for _, t in first + second})
    sheets = store.read(spark, store.sheets)
    assert sheets.count() == sheets.select("acta_id").distinct().count()


def test_a_batch_reads_only_its_own_prefixes(spark, tmp_path):
    store = ss.Store(str(tmp_path / "store"))
    ss.process_batch(frame(spark, crowd(60, 5)), 0, store, POLICY)
    every = store.read(spark, store.register).inputFiles()
    few = frame(spark, crowd(60, 5)[:3])
    wanted = ss.prefixes_of(few, ss.sms_hash(F.col("mensaje_raw")))
    read = store.read(spark, store.register, 1, wanted)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "prefijo" in plan.split("PartitionFilters: ")[1].split("]")[0]
    places = {r.prefijo for r in read.select("prefijo").distinct().collect()}
    assert places == set(wanted) and len(wanted) < len(every)
    assert read.select("hash_mensaje").distinct().count() >= len(wanted)


def test_dedup_within_watermark(spark, tmp_path):
    inbox = str(tmp_path / "in")
    frame(spark, [("+1", "a"), ("+1", "a"), ("+1", "b")]).coalesce(1).write.parquet(inbox)
    out = ss.dedup_stream(stream_sms(spark, inbox))
    query = out.writeStream.format("memory").queryName("dedup").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("dedup").count() == 2


def _log(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return events.select("event_id", F.col("user_id").cast("string").alias("acta_id"),
                         F.col("event_type").alias("tipo_evento"), F.col("ts").cast("timestamp").alias("fecha"))


def test_latest_state_updates(spark, tmp_path):
    log = _log(spark)
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    views.latest_state_updates(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    written = spark.read.parquet(out)
    newest = written.groupBy("acta_id").agg(F.max("eventos").alias("n"))
    assert {r.acta_id: r.n for r in newest.collect()} == {
        r.acta_id: r.eventos for r in latest_state(log).collect()}


def test_closed_arrival_windows(spark, tmp_path):
    log = _log(spark).select("fecha")
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(log.schema).parquet(folder)
    views.arrivals_stream(stream, "fecha", "1 hour", "10 minutes", out, str(tmp_path / "cp")).awaitTermination(120)
    closed = {tuple(r) for r in spark.read.parquet(out).collect()}
    everything = {tuple(r) for r in arrivals(log, "fecha", "1 hour").collect()}
    assert closed <= everything and len(everything) - len(closed) <= 2
