"""Continuously kept views over the event log and the arrivals."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from votecount.plans.replay import arrivals, latest_state


def latest_state_updates(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the sheets whose latest event changed in each micro-batch, for large logs."""

    def each(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{path}/lote={batch_id}")

    return (
        latest_state(events)
        .writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def arrivals_stream(
    rows: DataFrame, when: str, width: str, watermark: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append windows to a table as the watermark closes them."""
    return (
        arrivals(rows, when, width, watermark)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
