"""Readers for the file formats the counts arrive in."""

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount import constants as K
from votecount import schemas
from votecount.functions.scalars import prefix_int, trim_all
from votecount.operators.lineage import cut
from votecount.sources import quoted_csv as qc


def _csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Files of one folder, each by its own first line; columns are matched by name.

    Notes may hold line breaks within quotes. Files of one split go to Spark's reader, which takes
    such a file as a whole; larger ones are cut up (``quoted_csv``). Files with one header are read
    together; only their headers and names come to the driver.
    """
    splits = qc.scan(qc.lines_of(spark, path)).persist()
    try:
        heads = splits.where("head IS NOT NULL").select("f", "head")
        large = splits.where("b > 0").select("f").distinct()
        found = heads.join(large.withColumn("large", F.lit(True)), "f", "left").collect()
        groups: dict[tuple[str, bool], list[str]] = {}
        for r in found:
            groups.setdefault((r.head, bool(r.large)), []).append(r.f if r.large else unquote(r.f))
        starts = cut(qc.begins(splits)) if any(is_large for _, is_large in groups) else None
    finally:
        splits.unpersist()
    reader = spark.read.options(header=True, multiLine=True, **qc.OPTIONS)
    frames = []
    for (head, is_large), files in groups.items():
        if is_large:
            # Of the same listing, so that it is cut in the same places.
            lines = qc.lines_of(spark, path)
            if len(groups) > 1:
                lines = lines.where(F.col("f").isin(files))
            frames.append(qc.parsed(qc.records(lines, starts), head))
        else:
            frames.append(reader.csv(files if len(groups) > 1 else path))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else reader.csv(path)
    if schema is None:
        return raw
    return raw.select(
        *[trim_all(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_territory(spark: SparkSession, path: str) -> DataFrame:
    return territory_rows(_csv(spark, path, schemas.TERRITORY))


def territory_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("CodigoTerritorial").isNotNull()).select(
        F.col("CodigoTerritorial").alias("codigo_territorial"),
        F.col("Departamento").alias("departamento"),
        F.col("Provincia").alias("provincia"),
        F.col("Municipio").alias("municipio"),
    )


def read_precincts(spark: SparkSession, path: str) -> DataFrame:
    return precinct_rows(_csv(spark, path, schemas.PRECINCT))


def precinct_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("CodigoRecinto").isNotNull()).select(
        F.col("CodigoRecinto").alias("codigo_recinto"),
        F.col("CodigoTerritorial").alias("codigo_territorial"),
        F.col("RecintoNombre").alias("recinto"),
        F.col("RecintoDireccion").alias("direccion"),
        F.col("NumMesas").alias("num_mesas"),
    )


def read_mesas(spark: SparkSession, path: str) -> DataFrame:
    """Tables out of a transcription file; only the four columns are parsed."""
    return mesa_rows(_csv(spark, path))


def mesa_rows(raw: DataFrame) -> DataFrame:
    out = raw.select(
        prefix_int(F.col("CodigoRecinto")).alias("codigo_recinto"),
        prefix_int(F.col("CodigoActa")).alias("codigo_acta"),
        prefix_int(F.col("NroMesa")).cast("int").alias("nro_mesa"),
        prefix_int(F.col("VotantesHabilitados")).alias("votantes_habilitados"),
    )
    return out.where(F.coalesce("codigo_acta", F.lit(0)) != 0)


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    return transcription_rows(_csv(spark, path))


def _lenient(raw: DataFrame, name: str) -> Column:
    """Leading integer of a text column; 0 when missing or unreadable."""
    if name not in raw.columns:
        return F.lit(0).cast("bigint")
    return F.coalesce(prefix_int(trim_all(F.col(name))), F.lit(0).cast("bigint"))


def transcription_rows(raw: DataFrame) -> DataFrame:
    """Typed rows out of all-text ones; rows without a sheet code are skipped.

    A missing or zero hour becomes 8 for opening and 16 for closing.
    """
    for spelling, header in schemas.TRANSCRIPTION_ALIASES.items():
        if spelling in raw.columns and header not in raw.columns:
            raw = raw.withColumnRenamed(spelling, header)
    hour = lambda name, default: F.coalesce(
        F.nullif(_lenient(raw, name), F.lit(0).cast("bigint")), F.lit(default).cast("bigint")
    )
    notes = F.coalesce(trim_all(F.col("Observaciones")), F.lit("")) if "Observaciones" in raw.columns else F.lit("")
    out = raw.select(
        _lenient(raw, "CodigoActa").alias("codigo_acta"),
        _lenient(raw, "CodigoRecinto").alias("codigo_recinto"),
        _lenient(raw, "NroMesa").alias("nro_mesa"),
        *[_lenient(raw, header).alias(name) for name, header in schemas.TRANSCRIPTION_COUNTS.items()],
        hour("AperturaHora", 8).alias("apertura_hora"),
        hour("CierreHora", 16).alias("cierre_hora"),
        notes.alias("observaciones"),
    )
    return out.where(F.col("codigo_acta") != 0)


def read_sms(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SMS_MESSAGE).format(fmt).load(path)


def stream_sms(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schemas.SMS_MESSAGE)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def read_sheet_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, with its name (the sheet code may only be there)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_name").alias("file_name"), "content"
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Accepted files with extension, SHA-256 and size; extensions are case-sensitive."""
    extension = F.regexp_extract("file_name", r"(\.[^./]*)\z", 1)
    return (
        files.withColumn("extension", extension)
        .where(F.col("extension").isin(*K.FILE_EXTENSIONS))
        .select(
            "file_name", "extension",
            F.sha2("content", 256).alias("hash_origen"),
            F.octet_length("content").cast("bigint").alias("bytes"),
        )
    )


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; partitioning options pass through to the reader."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
