"""The message machine on a stream.

Each micro-batch runs the set-based plan against what earlier batches stored, and writes its
results into folders named after the batch. A batch that is run again after a failure reads
only the folders before its own and overwrites its own, so every message takes effect once.

A batch reads only the prefixes it holds and one running total (``store.py``), so that its cost
follows its own size and not the history. Messages, uploads and corrections share one store.
"""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from votecount import schemas
from votecount.functions.sms import parse_sms, sms_hash
from votecount.operators.events import sms_events, upload_events
from votecount.operators.lineage import forget
from votecount.operators.machine import (
    SAME_FILE,
    STORED,
    SmsPolicy,
    issues_of,
    sms_outcomes,
    sms_register,
    sms_sheets,
    upload_outcomes,
)
from votecount.plans.snapshot import long_snapshot, project_parts, signed_breakdown
from votecount.sources.sinks import exists, next_version, write_snapshot
from votecount.streaming.store import CORRECTION, SMS, UPLOAD, Store, prefixes_of


def process_batch(
    messages: DataFrame,
    batch: int,
    store: Store,
    policy: SmsPolicy,
    reference: DataFrame | None = None,
    printed: DataFrame | None = None,
) -> None:
    """Judge one set of messages and store register, sheets, events, log, totals and snapshot."""
    spark = messages.sparkSession
    # Only the looked-up columns and prefixes of the stored tables are read.
    register = None
    if exists(spark, store.register):
        texts = prefixes_of(messages, sms_hash(F.col("mensaje_raw")))
        register = store.read(spark, store.register, batch, texts)
        register = register.select("hash_mensaje", "acta_id") if register is not None else None
    sheets = None
    if exists(spark, store.sheets):
        ids = parse_sms(messages).select(F.col("sms_acta").alias("acta_id"))
        sheets = store.current_sheets(spark, ids, batch)
    copies: list[str] = []
    judged = sms_outcomes(messages, policy, reference, register, sheets, copies)
    # Reused by all writers; lost blocks are recomputed from the same inputs.
    judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        store.write(sms_events(judged), store.events, batch)
        store.write(issues_of(judged), store.inconsistencies, batch)
        store.write_sheets(sms_sheets(judged), batch, SMS)
        store.write(sms_register(judged), store.register, batch, key="hash_mensaje")
        store.add_to_totals(long_snapshot(sms_sheets(judged), issues_of(judged)), batch, SMS)
    finally:
        judged.unpersist()
        forget(spark, copies)
    store.merge(spark, batch, SMS)
    if printed is not None:
        refresh_snapshot(spark, store, printed, batch)


def process_uploads(
    files: DataFrame,
    batch: int,
    store: Store,
    reference: DataFrame,
    printed: DataFrame | None = None,
    keep_parser_errors: bool = False,
) -> None:
    """Judge one set of parsed files and store them beside the sheets of the messages.

    ``files``: sheets from text with seq, file_name, fecha_recepcion, hash_origen and
    validacion_visual. A file is refused if the store has its hash or its id, of whatever channel.
    """
    spark = files.sparkSession
    stored = store.known(files, batch, UPLOAD)
    copies: list[str] = []
    judged = upload_outcomes(files, reference, keep_parser_errors, stored, copies)
    judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept = judged.where(F.col("resultado") == STORED).select(*schemas.SHEET.fieldNames(), "seq")
        # What was logged when the same file came first is not logged again.
        fresh = judged.where(F.col("resultado") != SAME_FILE)
        store.write(upload_events(judged), store.events, batch, UPLOAD)
        store.write(issues_of(fresh), store.inconsistencies, batch, UPLOAD)
        store.write_sheets(kept, batch, UPLOAD)
        store.add_to_totals(long_snapshot(kept, issues_of(fresh)), batch, UPLOAD)
    finally:
        judged.unpersist()
        forget(spark, copies)
    store.merge(spark, batch, UPLOAD)
    if printed is not None:
        refresh_snapshot(spark, store, printed, batch)


def process_corrections(
    changes: DataFrame, batch: int, store: Store, printed: DataFrame | None = None
) -> None:
    """Give stored sheets a new state: (acta_id, estado, motivo_estado), one row per sheet.

    The sheet is written as a newer version; the totals change by the difference. A change of a
    sheet that is not stored, or to the state it has, does nothing.
    """
    spark = changes.sparkSession
    stored = store.current_sheets(spark, changes, batch, CORRECTION)
    if stored is None:
        return
    new = changes.select("acta_id", F.col("estado").alias("_estado"), F.col("motivo_estado").alias("_motivo"))
    met = stored.join(new, "acta_id").where(F.col("estado") != F.col("_estado")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        before = met.drop("_estado", "_motivo", "version")
        after = met.withColumns({"estado": F.col("_estado"), "motivo_estado": F.col("_motivo")}).select(before.columns)
        store.write_sheets(after, batch, CORRECTION, version=batch + 1)
        store.add_to_totals(signed_breakdown(before, after), batch, CORRECTION)
    finally:
        met.unpersist()
    store.merge(spark, batch, CORRECTION)
    if printed is not None:
        refresh_snapshot(spark, store, printed, batch)


def refresh_snapshot(spark: SparkSession, store: Store, printed: DataFrame, batch: int) -> None:
    """The statistics snapshot after a batch, from the running totals of all channels."""
    total = store.total(spark)
    if total is not None:
        write_snapshot(project_parts(total, printed), store.snapshot, next_version(spark, store.snapshot))


def run_sms_stream(
    source: DataFrame,
    store: Store,
    policy: SmsPolicy,
    checkpoint: str,
    reference: DataFrame | None = None,
    printed: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the stream; ``trigger`` defaults to working off what is there and stopping."""
    def each(batch_df: DataFrame, batch_id: int) -> None:
        process_batch(batch_df, batch_id, store, policy, reference, printed)

    return (
        source.select(*schemas.SMS_MESSAGE.fieldNames())
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_upload_stream(
    source: DataFrame,
    store: Store,
    reference: DataFrame,
    checkpoint: str,
    printed: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Store a stream of parsed files (``images.join_images`` gives them their image's flags)."""
    def each(batch_df: DataFrame, batch_id: int) -> None:
        process_uploads(batch_df, batch_id, store, reference, printed)

    return (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dedup_stream(source: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop repeated texts that arrive within the watermark, with bounded state.

    The exact way, for copies however late, is the look-up in the store that
    ``process_batch`` does.
    """
    keyed = source.withColumn("hash_mensaje", F.sha2("mensaje_raw", 256))
    return keyed.withWatermark("fecha_recepcion", watermark).dropDuplicatesWithinWatermark(
        ["hash_mensaje"]
    )
