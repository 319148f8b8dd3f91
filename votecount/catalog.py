"""The typed tables and the questions over them as names that SQL can use.

``register`` makes temporary views of tables and, over them, table functions with parameters. Views
and functions are plain queries: Catalyst puts them into whatever asks them, so a filter on a
function's result still reaches the scan, and nothing runs before it is asked for.

    register_folder(spark, "/data/votes")
    spark.sql("SELECT * FROM high_abstention(40.0) WHERE departamento = 'La Paz'")
    spark.sql("SELECT * FROM top_precincts('P2', 5)")
"""

from pyspark.sql import DataFrame, SparkSession

from votecount import constants as K
from votecount.sources.adapter import Election

#: Views by name, and what they are made of in an election.
VIEWS = {
    "distribucion_territorial": "territory",
    "recinto_electoral": "precincts",
    "mesas": "mesas",
    "papeleta": "official_sheets",
    "detalle_votos_partido": "official_votes",
    "transcripciones": "transcriptions",
    "actas_rrv": "sheets",
    "inconsistencias_rrv": "inconsistencies",
    "mensajes_sms": "messages",
    "eventos_rrv": "event_log",
}

_PARTY = " ".join(f"WHEN '{p}' THEN {p}" for p in K.PARTY_COLUMNS)
_SHARE = "CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0D END"

#: Table functions: parameters, columns and query. An unknown candidate has no votes anywhere.
FUNCTIONS = {
    "top_precincts": (
        f"candidate STRING, n INT DEFAULT {K.TOP_PRECINCTS}",
        "recinto STRING, votos BIGINT, candidato STRING",
        f"""SELECT recinto, votos, top_precincts.candidate AS candidato FROM (
              SELECT recinto, votos, row_number() OVER (ORDER BY votos DESC, recinto) AS puesto FROM (
                SELECT recinto, coalesce(sum(votos), 0) AS votos FROM (
                  SELECT recinto, CASE top_precincts.candidate {_PARTY} END AS votos FROM transcripciones)
                GROUP BY recinto))
            WHERE puesto <= CASE WHEN top_precincts.n > 0 THEN top_precincts.n ELSE {K.TOP_PRECINCTS} END""",
    ),
    "high_abstention": (
        f"threshold DOUBLE DEFAULT {K.ABSTENTION_THRESHOLD}D",
        "departamento STRING, recinto STRING, nro_mesa INT, codigo_acta BIGINT, votantes_habilitados BIGINT, "
        "votos_emitidos BIGINT, abstencion_pct DOUBLE",
        f"""SELECT * FROM (
              SELECT departamento, recinto, nro_mesa, codigo_acta, votantes_habilitados, papeletas_anfora,
                {_SHARE.format(part="(votantes_habilitados - papeletas_anfora)", whole="votantes_habilitados")} AS abstencion_pct
              FROM transcripciones)
            WHERE abstencion_pct > CASE WHEN high_abstention.threshold > 0 THEN high_abstention.threshold
                                        ELSE {K.ABSTENTION_THRESHOLD}D END""",
    ),
    "votes_below": (
        "department STRING, province STRING DEFAULT NULL",
        "geo STRING, P1 BIGINT, P2 BIGINT, P3 BIGINT, P4 BIGINT, total_votos BIGINT",
        """SELECT geo, coalesce(sum(P1), 0), coalesce(sum(P2), 0), coalesce(sum(P3), 0), coalesce(sum(P4), 0),
             coalesce(sum(P1 + P2 + P3 + P4), 0)
           FROM (SELECT CASE WHEN votes_below.province IS NULL THEN municipio ELSE provincia END AS geo, P1, P2, P3, P4
                 FROM transcripciones
                 WHERE departamento = coalesce(votes_below.department, departamento)
                   AND (votes_below.province IS NULL OR provincia = votes_below.province))
           GROUP BY geo""",
    ),
    "sheet_history": (
        "sheet STRING",
        "seccion STRING, detalle STRING, fecha TIMESTAMP",
        """SELECT 'evento', tipo_evento, fecha FROM eventos_rrv WHERE acta_id = sheet_history.sheet
           UNION ALL SELECT 'inconsistencia', tipo, fecha FROM inconsistencias_rrv WHERE acta_id = sheet_history.sheet
           UNION ALL SELECT 'estado_actual', estado, fecha_recepcion FROM actas_rrv WHERE acta_id = sheet_history.sheet""",
    ),
}


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Make views of the tables, and those functions whose views are all there; their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    made = []
    for name, (parameters, columns, body) in FUNCTIONS.items():
        if all(view in tables for view in VIEWS if view in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
            made.append(name)
    return [*tables, *made]


def register_folder(spark: SparkSession, folder: str) -> list[str]:
    """Register the election in a folder of tables."""
    e = Election(spark, folder)
    votes = e.vote_lines.select("codigo_acta", "id_partido", "cantidad_votos")
    return register(spark, {name: votes if name == "detalle_votos_partido" else getattr(e, made) for name, made in VIEWS.items()})
