"""Event replay: the history of sheets, and their latest state.

History comes as rows, not as one array per sheet, so a sheet with very many events is just
many rows. A global sort on (sheet, time) splits such a sheet over several ranges.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.operators.groups import stamp

#: All states a stored sheet can have.
_STATES = sorted((K.PROCESADA, K.ERROR, K.ANULADA, K.OBSERVADA))


def replay(
    events: DataFrame, inconsistencies: DataFrame, sheets: DataFrame, acta_id: str | None = None
) -> DataFrame:
    """Events, inconsistencies and current state as one timeline per sheet.

    With ``acta_id`` the filter reaches all three scans.
    """
    if acta_id is not None:
        events, inconsistencies, sheets = (
            d.where(F.col("acta_id") == acta_id) for d in (events, inconsistencies, sheets)
        )
    lines = (
        events.select("acta_id", F.lit("evento").alias("seccion"), F.col("tipo_evento").alias("detalle"),
                      "fecha")
        .unionByName(
            inconsistencies.select("acta_id", F.lit("inconsistencia").alias("seccion"),
                                   F.col("tipo").alias("detalle"), "fecha")
        )
        .unionByName(
            sheets.select("acta_id", F.lit("estado_actual").alias("seccion"),
                          F.col("estado").alias("detalle"), F.col("fecha_recepcion").alias("fecha"))
        )
    )
    return lines.orderBy("acta_id", "fecha", "seccion", "detalle")


def replay_counts(events: DataFrame, inconsistencies: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet: number of events and inconsistencies, first and last event, current state."""
    # A state goes in as its place among all states and comes out as its name: the largest of
    # numbers is found by hash aggregation, the largest of texts would sort all rows.
    place = F.array_position(F.array(*[F.lit(s) for s in _STATES]), F.col("estado"))
    none = F.lit(None).cast("bigint").alias("estado")
    parts = (
        events.select("acta_id", "fecha", F.lit(1).alias("e"), F.lit(0).alias("i"), none)
        .unionByName(
            inconsistencies.select("acta_id", F.lit(None).cast("timestamp").alias("fecha"),
                                   F.lit(0).alias("e"), F.lit(1).alias("i"), none)
        )
        .unionByName(
            sheets.select("acta_id", F.lit(None).cast("timestamp").alias("fecha"), F.lit(0).alias("e"),
                          F.lit(0).alias("i"), place.alias("estado"))
        )
    )
    return parts.groupBy("acta_id").agg(
        F.sum("e").alias("total_eventos"),
        F.sum("i").alias("total_inconsistencias"),
        F.min("fecha").alias("primer_evento"),
        F.max("fecha").alias("ultimo_evento"),
        F.get(F.array(*[F.lit(s) for s in _STATES]), F.max("estado") - 1).alias("estado_actual"),
    )


def latest_state(events: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """Most recent event of every sheet; works on a batch and on a stream.

    A batch finds the highest stamp by hash aggregation and joins its event; a stream, which
    has no second look at its rows, keeps the event beside the highest order seen.
    """
    if not events.isStreaming:
        order = stamp(F.col("fecha"), F.col(tiebreak), missing=-(10**18 - 1)).alias("_orden")
        rows = events.select("acta_id", "tipo_evento", "fecha", order)
        last = rows.groupBy("acta_id").agg(F.max("_orden").alias("_orden"), F.count(F.lit(1)).alias("eventos"))
        met = rows.where(F.col("acta_id").isNotNull()).join(last, ["acta_id", "_orden"])
        nameless = last.where(F.col("acta_id").isNull()).join(rows.where(F.col("acta_id").isNull()).drop("acta_id"), "_orden")
        columns = ["acta_id", F.col("tipo_evento").alias("ultimo_evento"), "fecha", "eventos"]
        return met.select(*columns).unionByName(nameless.select(*columns))
    order = F.struct("fecha", tiebreak)
    return (
        events.groupBy("acta_id")
        .agg(F.max_by(F.struct("tipo_evento", "fecha"), order).alias("_u"), F.count(F.lit(1)).alias("eventos"))
        .select("acta_id", F.col("_u.tipo_evento").alias("ultimo_evento"), F.col("_u.fecha").alias("fecha"),
                "eventos")
    )


def arrivals(df: DataFrame, when: str, width: str, watermark: str | None = None) -> DataFrame:
    """Rows per time window; on a stream the watermark bounds what is kept open."""
    rows = df.withWatermark(when, watermark) if watermark else df
    return (
        rows.groupBy(F.window(when, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("recibidas"))
        .select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "recibidas")
    )
