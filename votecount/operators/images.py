"""Flags of a sheet's image on the uploaded file, in a batch and on a stream.

Measurements are taken from the same file and know it by its hash. Only PDF files are judged by
their image; the others, and files whose image could not be measured, go on without flags.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount.schemas import VISUAL


def flags_struct(flags: DataFrame, *keys: Column) -> DataFrame:
    """Keys and ``validacion_visual`` of merged flags; flags that were not taken are NULL in it."""
    fields = [
        (F.col(f.name) if f.name in flags.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in VISUAL.fields
    ]
    return flags.select(*keys, F.struct(*fields).alias("validacion_visual"))


def _judged_by_image() -> Column:
    return F.endswith(F.col("file_name"), F.lit(".pdf"))


def with_images(files: DataFrame, flags: DataFrame) -> DataFrame:
    """Files with ``validacion_visual`` (NULL without a measurement); ``flags`` has one row per hash."""
    seen = flags_struct(flags, F.col("hash_origen").alias("_medida"))
    joined = files.join(seen, _judged_by_image() & (F.col("hash_origen") == F.col("_medida")), "left")
    return joined.drop("_medida")


def join_images(files: DataFrame, flags: DataFrame, late: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """The same on two streams: a file waits for its measurement, ``late`` at most.

    ``files`` arrive at ``fecha_recepcion``, ``flags`` (with the time ``medida_en``) after them. Both
    sides carry a watermark and the times are bound to each other, so that state is dropped once no
    partner can come; a file whose measurement has not come by then is given out without one.
    """
    seen = flags_struct(flags.withWatermark("medida_en", watermark), F.col("hash_origen").alias("_medida"), F.col("medida_en"))
    waiting = files.withWatermark("fecha_recepcion", watermark)
    met = (
        _judged_by_image() & (F.col("hash_origen") == F.col("_medida"))
        & (F.col("medida_en") >= F.col("fecha_recepcion"))
        & (F.col("medida_en") <= F.col("fecha_recepcion") + F.expr(f"INTERVAL {late}"))
    )
    return waiting.join(seen, met, "left_outer").drop("_medida", "medida_en")

