"""Tables behind the dashboard: official, quick and compared."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import half_even_1dec, total_or_zero
from votecount.functions.sms import parse_sms
from votecount.operators.official import pivot_votes

MEASURES = ["VotantesHabilitados", "VotosValidos", "VotosBlancos", "VotosNulos", *K.PARTY_COLUMNS]


def _add_up(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[total_or_zero(F.col(m)).alias(m) for m in MEASURES])


def official_by_municipality(
    territory: DataFrame, precincts: DataFrame, mesas: DataFrame, sheets: DataFrame, votes: DataFrame
) -> DataFrame:
    """Five-table roll-up: territory, place, table and sheet, with the votes pivoted first.

    Dimensions carry no hint: they are broadcast only when their measured size allows it,
    otherwise joined by sort-merge with skewed places split at run time. The sums are taken
    per place before the territory is joined, so that join sees one row per place.
    """
    per_sheet = (
        mesas.join(sheets, "codigo_acta")
        .join(pivot_votes(votes), "codigo_acta", "left")
        .select(
            "codigo_recinto",
            F.col("votantes_habilitados").alias("VotantesHabilitados"),
            F.col("votos_validos").alias("VotosValidos"),
            F.col("votos_blancos").alias("VotosBlancos"),
            F.col("votos_nulos").alias("VotosNulos"),
            *K.PARTY_COLUMNS,
        )
    )
    per_place = _add_up(per_sheet, "codigo_recinto")
    places = precincts.select("codigo_recinto", "codigo_territorial")
    names = territory.select(
        "codigo_territorial",
        F.col("departamento").alias("Departamento"),
        F.col("municipio").alias("Municipio"),
    )
    placed = per_place.join(places, "codigo_recinto").join(names, "codigo_territorial")
    return _add_up(placed, "Departamento", "Municipio")


def roll_up(municipalities: DataFrame) -> DataFrame:
    return _add_up(municipalities, "Departamento")


def dashboard_turnout(df: DataFrame) -> DataFrame:
    """Valid votes over registered voters, one decimal, ties to even; 0 without voters."""
    share = half_even_1dec(F.col("VotosValidos") / F.col("VotantesHabilitados") * 100)
    return df.withColumn("Participacion", F.when(F.col("VotantesHabilitados") != 0, share).otherwise(0.0))


def winner_code() -> Column:
    """Party with most votes; of tied ones the lowest-numbered."""
    top = F.greatest(*K.PARTY_COLUMNS)
    first, *rest = K.PARTY_COLUMNS
    code = F.when(F.col(first) == top, first)
    for p in rest:
        code = code.when(F.col(p) == top, p)
    return code


def party_name(code: Column) -> Column:
    name = F.lit(None).cast("string")
    for p, label in K.DASHBOARD_PARTY_NAMES.items():
        name = F.when(code == p, label).otherwise(name)
    return name


def with_winner(df: DataFrame) -> DataFrame:
    """Turnout, winner code, winner name and the winner's votes."""
    return (
        dashboard_turnout(df)
        .withColumn("GanadorCodigo", winner_code())
        .withColumn("Ganador", party_name(F.col("GanadorCodigo")))
        .withColumn("VotosGanador", F.greatest(*K.PARTY_COLUMNS))
    )


def national_totals(df: DataFrame) -> DataFrame:
    """One row of totals with the national winner and the share of each party."""
    total = df.agg(*[total_or_zero(F.col(m)).alias(m) for m in MEASURES])
    share = lambda p: F.when(
        F.col("VotosValidos") > 0, F.col(p) / F.col("VotosValidos") * 100
    ).otherwise(0.0)
    return (
        total.withColumn("GanadorCodigo", winner_code())
        .withColumn("Ganador", party_name(F.col("GanadorCodigo")))
        .withColumns({f"pct_{p}": share(p) for p in K.PARTY_COLUMNS})
    )


def winner_table(departments: DataFrame) -> DataFrame:
    return (
        with_winner(departments)
        .orderBy(F.desc("VotosValidos"), "Departamento")
        .select("Departamento", "Ganador", "VotosGanador", "Participacion", "VotosValidos")
    )


def municipality_table(municipalities: DataFrame) -> DataFrame:
    return (
        with_winner(municipalities)
        .orderBy("Departamento", F.desc("VotosValidos"), "Municipio")
        .select("Departamento", "Municipio", *K.PARTY_COLUMNS, "VotosValidos", "VotosBlancos",
                "VotosNulos", "Participacion", "Ganador")
    )


def turnout_ranking(departments: DataFrame) -> DataFrame:
    return (
        dashboard_turnout(departments)
        .select("Departamento", "Participacion")
        .orderBy("Participacion", "Departamento")
    )


def melt_parties(df: DataFrame) -> DataFrame:
    """One row per department and party, with the party's display name."""
    return df.unpivot("Departamento", list(K.PARTY_COLUMNS), "Partido", "Votos").withColumn(
        "PartidoLabel", party_name(F.col("Partido"))
    )


def centroids(spark) -> DataFrame:
    rows = [(d, lat, lon) for d, (lat, lon) in K.DEPARTMENT_CENTROIDS.items()]
    return spark.createDataFrame(rows, "Departamento string, lat double, lon double")


def with_centroids(departments: DataFrame, party: str) -> DataFrame:
    """Map points of one party; departments without coordinates are dropped."""
    points = centroids(departments.sparkSession)
    return departments.select("Departamento", F.col(party).alias("Votos")).join(points, "Departamento")


# Row labels of the comparison, in order.
_CATEGORIES = [
    ("Votos Válidos", "VotosValidos"),
    ("Votos Blancos", "VotosBlancos"),
    ("Votos Nulos", "VotosNulos"),
    *[(K.DASHBOARD_PARTY_NAMES[p], p) for p in K.PARTY_COLUMNS],
]


def comparison_table(official: DataFrame, quick: DataFrame) -> DataFrame:
    """Totals of both counts per category and official minus quick."""
    rows = ", ".join(f"{i}, '{label}', {column}" for i, (label, column) in enumerate(_CATEGORIES, 1))

    def long(df, name):
        return national_totals(df).selectExpr(
            f"stack({len(_CATEGORIES)}, {rows}) as (orden, categoria, {name})"
        )

    both = long(official, "oficial").join(long(quick, "rapido").drop("categoria"), "orden")
    return both.withColumn("diferencia", F.col("oficial") - F.col("rapido")).orderBy("orden").drop("orden")


def sms_by_municipality(register: DataFrame) -> DataFrame:
    """Quick-count table rebuilt from the raw text of processed messages."""
    parsed = parse_sms(register.where(F.col("estado") == K.SMS_PROCESADO), strict=False)
    zero = F.lit(0).cast("bigint")
    votes = lambda i: F.coalesce(
        F.get(F.filter("candidatos", lambda c: c["candidato_id"] == f"C{i}"), 0)["votos"], zero
    )
    rows = parsed.select(
        F.coalesce("sms_dep", F.lit("Desconocido")).alias("Departamento"),
        F.coalesce("sms_mun", F.lit("Desconocido")).alias("Municipio"),
        (F.col("sms_val") + F.col("sms_nul") + F.col("sms_bla")).alias("VotantesHabilitados"),
        F.col("sms_val").alias("VotosValidos"),
        F.col("sms_bla").alias("VotosBlancos"),
        F.col("sms_nul").alias("VotosNulos"),
        *[votes(i).alias(f"P{i}") for i in range(1, 5)],
    )
    return _add_up(rows, "Departamento", "Municipio")
