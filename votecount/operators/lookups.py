"""Listings, point lookups and small reshapes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import pct


def list_sheets(
    sheets: DataFrame,
    department: str | None = None,
    state: str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Sheets under optional equality filters, newest first; empty filters are ignored."""
    out = sheets
    for column, wanted in (("departamento", department), ("estado", state), ("tipo_entrada", kind)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    return out.orderBy(F.desc("fecha_recepcion"), "acta_id")


def get_sheet(sheets: DataFrame, acta_id: str) -> DataFrame:
    return sheets.where(F.col("acta_id") == acta_id)


def get_by_hash(sheets: DataFrame, digest: str) -> DataFrame:
    return sheets.where(F.col("hash_origen") == digest)


def latest(df: DataFrame, when: str, tiebreak: str, n: int = K.LATEST_ROWS) -> DataFrame:
    """Newest n rows; planned as a per-partition top-n followed by a merge of n rows each."""
    return df.orderBy(F.desc(when), F.desc(tiebreak)).limit(n)


def by_sheet(df: DataFrame, acta_id: str, when: str = "fecha", tiebreak: str | None = None) -> DataFrame:
    keys = [when] + ([tiebreak] if tiebreak else [])
    return df.where(F.col("acta_id") == acta_id).orderBy(*keys)


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """Any number of conditional counts in one pass."""
    return df.agg(*[F.count_if(c).cast("bigint").alias(n) for n, c in conditions.items()])


def count_by(df: DataFrame, field: str) -> DataFrame:
    """Rows per value of a field; NULL and empty values are left out."""
    return (
        df.where(F.col(field).isNotNull() & (F.col(field) != ""))
        .groupBy(field)
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )


def annulled_sheets(sheets: DataFrame) -> DataFrame:
    return list_sheets(sheets, state=K.ANULADA).select(
        F.col("acta_id").alias("id_boleta"), "recinto", "mesa",
        F.col("motivo_estado").alias("motivo_anulacion"),
    )


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def limit_scan(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, as a bounded read."""
    return df.limit(n)


def to_mesas(printed: DataFrame) -> DataFrame:
    """Printed sheet registry under the column names of the table registry."""
    return printed.select(
        F.col("codigo_acta").alias("CodigoMesa"),
        F.col("nro_mesa").alias("NroMesa"),
        F.col("votantes_habilitados").alias("CantidadHabilitada"),
        F.col("codigo_recinto").alias("CodigoRecintoElectoral"),
    )


def with_party_names(df: DataFrame, parties: DataFrame, code: str, name: str = "candidato") -> DataFrame:
    """Name for a party or candidate code; unknown codes stand for themselves.

    ``parties`` has (codigo, nombre); the size of the dimension decides how it is joined.
    """
    dim = parties.select(F.col("codigo").alias(code), F.col("nombre").alias("_nombre"))
    return df.join(dim, code, "left").withColumn(name, F.coalesce("_nombre", code)).drop("_nombre")


def candidate_dimension(spark) -> DataFrame:
    """Every spelling of a candidate code (P1, C1, 1) with the candidate's name."""
    rows = [
        (prefix + code[1:], name)
        for code, name in K.CANDIDATE_NAMES.items()
        for prefix in ("P", "C", "")
    ]
    return spark.createDataFrame(rows, "codigo string, nombre string")


def sheet_share(sheets: DataFrame) -> DataFrame:
    """Valid-vote share of each sheet to one decimal; a zero total falls back to the sum."""
    parts = F.col("votos_validos") + F.col("votos_blancos") + F.col("votos_nulos")
    total = F.when(F.coalesce("total_votos", F.lit(0)) != 0, F.col("total_votos")).otherwise(parts)
    share = F.when(total > 0, F.round(F.col("votos_validos") / total * 100, 1)).otherwise(0.0)
    return sheets.select("acta_id", "votos_validos", total.alias("total"), share.alias("pct_validos"))


def with_placeholder(df: DataFrame, label: str = "Sin Datos") -> DataFrame:
    """The rows, or a single placeholder row when there are none."""
    text = {"Departamento", "Municipio"}
    row = df.sparkSession.range(1).select(
        *[
            F.lit(label if f.name in text else (1 if f.name == "VotantesHabilitados" else 0))
            .cast(f.dataType)
            .alias(f.name)
            for f in df.schema.fields
        ]
    )
    present = df.limit(1).select(F.lit(1).alias("_hay"))
    return df.unionByName(row.join(present, F.lit(True), "left_anti"))


def batch_summary(sheets: DataFrame) -> DataFrame:
    """Sheets per state and reason with the share of all sheets."""
    groups = sheets.groupBy("estado", F.coalesce("motivo_estado", F.lit("")).alias("motivo")).agg(
        F.count(F.lit(1)).alias("cantidad")
    )
    total = groups.agg(F.sum("cantidad").alias("_total"))
    return (
        groups.crossJoin(F.broadcast(total))
        .select("estado", "motivo", "cantidad", pct(F.col("cantidad"), F.col("_total")).alias("porcentaje"))
        .orderBy("estado", "motivo")
    )


def batch_candidates(sheets: DataFrame) -> DataFrame:
    """Votes per candidate over processed sheets, with the share of valid votes."""
    good = sheets.where(F.col("estado") == K.PROCESADA)
    votes = good.agg(
        *[
            F.coalesce(F.sum(F.get("candidatos", i)["votos"]), F.lit(0)).alias(f"v{i + 1}")
            for i in range(4)
        ],
        F.coalesce(F.sum("votos_validos"), F.lit(0)).alias("_validos"),
    )
    names = ", ".join(
        f"'{name}', v{i}" for i, name in enumerate(K.CANDIDATE_NAMES.values(), start=1)
    )
    return votes.selectExpr("_validos", f"stack(4, {names}) as (candidato, votos)").select(
        "candidato", "votos",
        F.when(F.col("_validos") > 0, F.col("votos") / F.col("_validos") * 100).otherwise(0.0).alias("porcentaje"),
    )


def batch_departments(sheets: DataFrame) -> DataFrame:
    return (
        sheets.where((F.col("estado") == K.PROCESADA) & (F.col("departamento") != ""))
        .groupBy("departamento")
        .agg(F.count(F.lit(1)).alias("actas"), F.sum("total_votos").alias("votos"))
    )


def first_errors(sheets: DataFrame, order: str, n: int = 10) -> DataFrame:
    """First n sheets in error, in processing order, with their texts."""
    return (
        sheets.where((F.col("estado") == K.ERROR) & (F.size("errores") > 0))
        .orderBy(order)
        .limit(n)
        .select("acta_id", "estado", F.array_join("errores", " | ").alias("errores"))
    )
