"""The latest event of every sheet as keyed state, instead of an aggregate over texts.

Each sheet has one small state record in the state store (RocksDB, so it need not fit in memory):
the newest event, its order and the number of events. A micro-batch touches the records of its own
sheets only and gives out those that changed; an event that comes late counts, but replaces nothing
newer. A sheet without an event for ``timeout`` is given out once more as closed, and its record is
dropped, so that the state holds the open sheets and not all there ever were.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "acta_id string, ultimo_evento string, fecha timestamp, eventos bigint, cerrada boolean"
_STATE = "tipo_evento string, fecha timestamp, event_id bigint, eventos bigint, hasta bigint"


class LatestEvent(StatefulProcessor):
    """Keeps (tipo_evento, fecha, event_id, eventos) of one sheet; ``timeout_ms`` of 0 keeps it for ever."""

    def __init__(self, timeout_ms: int = 0):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("ultimo", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, when, number, count, until = self.last.get() if self.last.exists() else (None, None, None, 0, 0)
        newest = None if number is None else (_order(when), number)
        for part in rows:
            count += len(part)
            times = part["fecha"]
            for t, n, k in zip(times, part["event_id"], part["tipo_evento"], strict=True):
                order = (_order(t), int(n))
                if newest is None or order > newest:
                    newest, kind, when, number = order, k, None if pd.isna(t) else t.to_pydatetime(), int(n)
        if self.timeout_ms:
            if until:
                self.handle.deleteTimer(until)
            until = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(until)
        self.last.update((kind, when, number, count, until))
        yield self._row(key, kind, when, count, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            kind, when, _, count, _ = self.last.get()
            self.last.clear()
            yield self._row(key, kind, when, count, True)

    def close(self) -> None:
        pass

    def _row(self, key, kind, when, count, closed) -> pd.DataFrame:
        return pd.DataFrame(
            {"acta_id": [key[0]], "ultimo_evento": [kind], "fecha": pd.Series([when], dtype="datetime64[ns]"),
             "eventos": [count], "cerrada": [closed]}
        )


def _order(t) -> int:
    """Events without a time come before all others, as in the batch."""
    return -(10**18) if t is None or pd.isna(t) else pd.Timestamp(t).value // 1000


def latest_events(events: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """Changed sheets of every micro-batch; ``events``: acta_id, tipo_evento, fecha, event_id."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("acta_id", "tipo_evento", "fecha", events["event_id"].cast("bigint").alias("event_id"))
    return rows.groupBy("acta_id").transformWithStateInPandas(
        LatestEvent(timeout_ms), outputStructType=COLUMNS, outputMode="Update", timeMode="ProcessingTime" if timeout_ms else "None"
    )


def latest_event_updates(events: DataFrame, path: str, checkpoint: str, timeout_ms: int = 0, **trigger) -> StreamingQuery:
    """Write the sheets whose latest event or number of events changed, a folder per micro-batch."""

    def each(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{path}/lote={batch_id}")

    spark = events.sparkSession
    trigger = trigger or {"availableNow": True}
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, "true")
    # With timers there is always a next batch, so a query that shall end runs none without rows.
    spark.conf.set(idle, "false" if timeout_ms and not {"processingTime", "realTime"} & trigger.keys() else before)
    try:
        writer = latest_events(events, timeout_ms).writeStream.outputMode("update").foreachBatch(each)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(idle, before)
