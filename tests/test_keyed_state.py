"""The latest event of a sheet as keyed state."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from votecount.plans.replay import latest_state
from votecount.streaming import state

SCHEMA = "event_id long, acta_id string, tipo_evento string, fecha timestamp"
T0 = datetime(2026, 5, 3, 8)


def _newest(spark, out):
    """The last row given out for each sheet."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("acta_id").agg(F.max("eventos").alias("eventos"))
    return {r.acta_id: (r.ultimo_evento, r.fecha, r.eventos) for r in rows.join(last, ["acta_id", "eventos"]).collect()}


def test_equals_the_batch_with_late_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", F.col("user_id").cast("string").alias("acta_id"), F.col("event_type").alias("tipo_evento"),
        F.col("ts").cast("timestamp").alias("fecha"))
    log = str(tmp_path / "log")
    # Newest first: all but the first file hold late events only.
    for n, part in enumerate((F.col("event_id") % 3 == 2, F.col("event_id") % 3 == 1, F.col("event_id") % 3 == 0)):
        events.where(part).orderBy(F.desc("fecha")).coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
    query = state.latest_event_updates(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    wanted = {r.acta_id: (r.ultimo_evento, r.fecha, r.eventos) for r in latest_state(events).collect()}
    assert _newest(spark, str(tmp_path / "out")) == wanted


def test_only_changed_sheets_are_given_out_and_idle_ones_are_closed(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(log)

    def run(timeout_ms):
        stream = spark.readStream.schema(SCHEMA).parquet(log)
        query = state.latest_event_updates(stream, out, str(tmp_path / "cp"), timeout_ms)
        query.awaitTermination(120)
        assert query.exception() is None

    add((1, "A", "ACTA_RECIBIDA", T0), (2, "B", "ACTA_RECIBIDA", None), (3, "A", "ACTA_GUARDADA", T0 + timedelta(minutes=1)))
    run(1)
    time.sleep(0.1)
    add((4, "C", "ACTA_RECIBIDA", T0))
    run(1)
    lots = [sorted((r.acta_id, r.ultimo_evento, r.eventos, r.cerrada) for r in spark.read.parquet(f"{out}/lote={n}").collect())
            for n in (0, 1)]
    assert lots[0] == [("A", "ACTA_GUARDADA", 2, False), ("B", "ACTA_RECIBIDA", 1, False)]
    assert lots[1] == [("A", "ACTA_GUARDADA", 2, True), ("B", "ACTA_RECIBIDA", 1, True), ("C", "ACTA_RECIBIDA", 1, False)]
