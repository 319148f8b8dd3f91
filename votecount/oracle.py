"""The same questions in plain SQL over the same tables.

Parsers are checked against the columns the texts were made from, never against the parsed
text, and duplicate decisions against the numbers that planted the duplicates.
"""

_BASE = """
terr AS (
  SELECT n_nationkey AS codigo_territorial,
         CASE r_regionkey WHEN 0 THEN 'Chuquisaca' WHEN 1 THEN 'La Paz' WHEN 2 THEN 'Cochabamba'
              WHEN 3 THEN 'Potosí' ELSE 'Exterior' END AS departamento,
         n_name AS municipio
  FROM nation JOIN region ON n_regionkey = r_regionkey),
prec AS (
  SELECT c_custkey AS codigo_recinto, c_name AS recinto, c_nationkey AS codigo_territorial,
         c_mktsegment AS provincia FROM customer),
places AS (SELECT * FROM prec JOIN terr USING (codigo_territorial)),
vl AS (
  SELECT l_orderkey AS k, l_orderkey + 1010200000000 AS codigo_acta, l_linenumber AS id_partido,
         CAST(l_quantity AS BIGINT) AS cantidad_votos FROM lineitem),
piv AS (
  SELECT k, CAST(sum(CASE WHEN id_partido = 1 THEN cantidad_votos ELSE 0 END) AS BIGINT) AS P1,
         CAST(sum(CASE WHEN id_partido = 2 THEN cantidad_votos ELSE 0 END) AS BIGINT) AS P2,
         CAST(sum(CASE WHEN id_partido = 3 THEN cantidad_votos ELSE 0 END) AS BIGINT) AS P3,
         CAST(sum(CASE WHEN id_partido = 4 THEN cantidad_votos ELSE 0 END) AS BIGINT) AS P4,
         CAST(sum(CASE WHEN id_partido = 5 THEN cantidad_votos ELSE 0 END) AS BIGINT) AS votos_blancos,
         CAST(sum(CASE WHEN id_partido IN (6, 7) THEN cantidad_votos ELSE 0 END) AS BIGINT) AS votos_nulos
  FROM vl GROUP BY k),
t1 AS (
  SELECT o_orderkey AS k, o_custkey AS codigo_recinto, o_orderdate AS dia, o_orderpriority AS prioridad,
         coalesce(P1, 0) AS P1, coalesce(P2, 0) AS P2, coalesce(P3, 0) AS P3, coalesce(P4, 0) AS P4,
         coalesce(votos_blancos, 0) AS votos_blancos, coalesce(votos_nulos, 0) AS votos_nulos
  FROM orders LEFT JOIN piv ON o_orderkey = k),
t2 AS (SELECT *, P1 + P2 + P3 + P4 + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS votos_validos FROM t1),
t3 AS (SELECT *, votos_validos + votos_blancos + votos_nulos
              + CASE WHEN k % 80 = 0 THEN 2 ELSE 0 END AS papeletas_anfora FROM t2),
t4 AS (SELECT *, CASE WHEN k % 45 = 0 THEN greatest(papeletas_anfora - 4, 0)
                      ELSE papeletas_anfora + k * 31 % 60 END AS votantes_habilitados FROM t3),
tal AS (
  SELECT *, k + 1010200000000 AS codigo_acta, CAST(k % 60 + 1 AS INTEGER) AS nro_mesa,
         votantes_habilitados - papeletas_anfora + CASE WHEN k % 70 = 0 THEN 3 ELSE 0 END AS papeletas_no_utilizadas,
         CASE WHEN k % 40 = 0 THEN '0' ELSE '8' END AS apertura_hora, '16' AS cierre_hora
  FROM t4),
tr AS (SELECT * FROM tal JOIN places USING (codigo_recinto)),
done AS (SELECT o_orderkey + 1010200000000 AS codigo_acta FROM orders WHERE o_orderstatus = 'F'),
muni AS (
  SELECT departamento AS "Departamento", municipio AS "Municipio",
         CAST(sum(votantes_habilitados) AS BIGINT) AS "VotantesHabilitados",
         CAST(sum(votos_validos) AS BIGINT) AS "VotosValidos", CAST(sum(votos_blancos) AS BIGINT) AS "VotosBlancos",
         CAST(sum(votos_nulos) AS BIGINT) AS "VotosNulos", CAST(sum(P1) AS BIGINT) AS "P1",
         CAST(sum(P2) AS BIGINT) AS "P2", CAST(sum(P3) AS BIGINT) AS "P3", CAST(sum(P4) AS BIGINT) AS "P4"
  FROM tr GROUP BY 1, 2),
dept AS (
  SELECT "Departamento", CAST(sum("VotantesHabilitados") AS BIGINT) AS "VotantesHabilitados",
         CAST(sum("VotosValidos") AS BIGINT) AS "VotosValidos", CAST(sum("VotosBlancos") AS BIGINT) AS "VotosBlancos",
         CAST(sum("VotosNulos") AS BIGINT) AS "VotosNulos", CAST(sum("P1") AS BIGINT) AS "P1",
         CAST(sum("P2") AS BIGINT) AS "P2", CAST(sum("P3") AS BIGINT) AS "P3", CAST(sum("P4") AS BIGINT) AS "P4"
  FROM muni GROUP BY 1)"""

_SUBMITTED = """,
sub AS (
  SELECT k * 2 + copia AS fila, copia, k,
         CASE WHEN k % 75 = 0 THEN 2000000000000 + k % 4 * 10000000 ELSE codigo_acta END AS codigo_acta,
         codigo_recinto, P1, P2, P3, P4, votos_validos, votos_blancos, votos_nulos, papeletas_anfora,
         papeletas_no_utilizadas, votantes_habilitados
  FROM tal CROSS JOIN (VALUES (0), (1)) c(copia) WHERE copia = 0 OR k % 33 = 0),
rul AS (
  SELECT *, CASE
    WHEN k % 75 = 0 THEN 'Acta no encontrada'
    WHEN P1 + P2 + P3 + P4 <> votos_validos THEN 'La suma de votos por partido no coincide con los votos válidos'
    WHEN votos_validos + votos_blancos + votos_nulos <> papeletas_anfora
      THEN 'Los votos válidos, blancos y nulos no coinciden con las papeletas en ánfora'
    WHEN papeletas_anfora + papeletas_no_utilizadas <> votantes_habilitados
      THEN 'Las papeletas en ánfora más las no utilizadas no coinciden con los votantes habilitados'
    WHEN copia = 1 THEN 'El acta ya fue transcrita' END AS motivo
  FROM sub)"""

_QUICK = """,
rep AS (
  SELECT *, CASE WHEN prioridad IN ('1-URGENT', '2-HIGH') THEN 'SMS' WHEN prioridad = '3-MEDIUM' THEN 'IMAGEN'
                 ELSE 'PDF' END AS tipo_entrada,
         dia + to_seconds(k * 37 % 86400) AS fecha_recepcion,
         P1 + CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END AS c1
  FROM tr),
sh0 AS (
  SELECT k, 'MESA-' || codigo_acta AS acta_id, codigo_acta, codigo_recinto, departamento,
         CASE WHEN k % 97 = 0 THEN '' ELSE municipio END AS municipio, recinto, nro_mesa, c1, P2, P3, P4,
         votos_validos, votos_blancos, votos_nulos,
         votos_validos + votos_blancos + votos_nulos + CASE WHEN k % 110 = 0 THEN 1 ELSE 0 END AS total_votos,
         votantes_habilitados + CASE WHEN k % 60 = 0 THEN 5 ELSE 0 END AS electores_habilitados,
         papeletas_anfora + CASE WHEN k % 90 = 0 THEN 1 ELSE 0 END AS anfora_reportada,
         papeletas_anfora AS ref_anfora, votantes_habilitados AS ref_hab, apertura_hora, cierre_hora,
         tipo_entrada, tipo_entrada <> 'SMS' AS v, fecha_recepcion
  FROM rep),
sh1 AS (
  SELECT *,
    CASE WHEN municipio = '' THEN 'campo obligatorio: municipio vacío' END AS e1,
    CASE WHEN votos_validos > 0 AND c1 + P2 + P3 + P4 <> votos_validos
      THEN 'inconsistencia aritmética: suma_candidatos(' || (c1 + P2 + P3 + P4) || ') != votos_validos(' || votos_validos || ')' END AS e2,
    CASE WHEN total_votos > 0 AND votos_validos + votos_blancos + votos_nulos <> total_votos
      THEN 'inconsistencia en total: validos(' || votos_validos || ') + blancos(' || votos_blancos || ') + nulos('
           || votos_nulos || ') = ' || (votos_validos + votos_blancos + votos_nulos) || ', pero total_votos = ' || total_votos END AS e3,
    CASE WHEN v AND k % 53 = 0 THEN 'NULIDAD — USO DE LÁPIZ: intensidad promedio 153.3, contraste 0.412' END AS e4,
    CASE WHEN v AND k % 61 = 0 THEN 'NULIDAD — TACHADURA: números superpuestos detectados' END AS e5,
    CASE WHEN v AND k % 71 = 0 THEN 'NULIDAD — TEXTO ''ANULADA'' escrito sobre el acta' END AS e6,
    CASE WHEN v AND k % 67 = 0 THEN 'NULIDAD — ROTURA CRÍTICA: sección faltante del papel' END AS e7,
    CASE WHEN v AND k % 59 = 0 THEN 'NULIDAD — FIRMAS INSUFICIENTES: 2 huellas detectadas (mínimo 3)' END AS e8,
    CASE WHEN v AND k % 41 = 0 THEN 'OBSERVACIÓN — MANCHA sobre datos: 4.3% del área afectada' END AS e9,
    CASE WHEN electores_habilitados > 0 AND total_votos > electores_habilitados
      THEN 'NULIDAD — VOTOS > VOTANTES: total_votos(' || total_votos || ') > electores_habilitados(' || electores_habilitados || ')' END AS e10
  FROM sh0),
sh AS (
  SELECT *, concat_ws(' | ', e1, e2, e3, e4, e5, e6, e7, e8, e9, e10) AS errores,
    CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT + (e4 IS NOT NULL)::INT + (e5 IS NOT NULL)::INT
      + (e6 IS NOT NULL)::INT + (e7 IS NOT NULL)::INT + (e8 IS NOT NULL)::INT + (e9 IS NOT NULL)::INT + (e10 IS NOT NULL)::INT AS INTEGER) AS n_errores,
    CASE WHEN coalesce(e6, e4, e5, e7, e8, e10) IS NOT NULL THEN 'ANULADA'
         WHEN coalesce(e1, e2, e3) IS NOT NULL THEN 'ERROR'
         WHEN e9 IS NOT NULL THEN 'OBSERVADA' ELSE 'PROCESADA' END AS estado,
    CASE WHEN e6 IS NOT NULL THEN 'TEXTO_ANULADA_VISUAL' WHEN e4 IS NOT NULL THEN 'USO_DE_LAPIZ'
         WHEN e5 IS NOT NULL THEN 'TACHADURA_NUMEROS' WHEN e7 IS NOT NULL THEN 'ROTURA_CRITICA'
         WHEN e8 IS NOT NULL THEN 'FALTA_FIRMAS_HUELLAS' WHEN e10 IS NOT NULL THEN 'VOTOS_MAYOR_QUE_VOTANTES'
         WHEN coalesce(e1, e2, e3) IS NULL AND e9 IS NOT NULL THEN 'MANCHA_SOBRE_DATOS' ELSE '' END AS motivo_estado
  FROM sh1),
good AS (SELECT * FROM sh WHERE estado = 'PROCESADA'),
cand AS (
  SELECT 'C1' AS candidato_id, CAST(coalesce(sum(c1), 0) AS BIGINT) AS votos FROM good
  UNION ALL SELECT 'C2', CAST(coalesce(sum(P2), 0) AS BIGINT) FROM good
  UNION ALL SELECT 'C3', CAST(coalesce(sum(P3), 0) AS BIGINT) FROM good
  UNION ALL SELECT 'C4', CAST(coalesce(sum(P4), 0) AS BIGINT) FROM good)"""

_ARITHMETIC = """
  SELECT k, acta_id, 'INCONSISTENCIA_ARITMETICA' AS tipo,
         'Suma de votos por candidatos (' || (c1 + P2 + P3 + P4) || ') no coincide con votos válidos (' || votos_validos || ')' AS descripcion,
         'CRITICA' AS severidad FROM sh WHERE votos_validos > 0 AND c1 + P2 + P3 + P4 <> votos_validos
  UNION ALL
  SELECT k, acta_id, 'INCONSISTENCIA_ARITMETICA',
         'Total votos (' || total_votos || ') ≠ válidos(' || votos_validos || ')+blancos(' || votos_blancos || ')+nulos('
         || votos_nulos || ')=' || (votos_validos + votos_blancos + votos_nulos), 'ALTA'
  FROM sh WHERE total_votos > 0 AND total_votos <> votos_validos + votos_blancos + votos_nulos"""

_CONTRADICTORY = """
  SELECT k, acta_id, 'DATOS_CONTRADICTORIOS' AS tipo,
         'Votantes habilitados reportados (' || electores_habilitados || ') ≠ registro oficial (' || ref_hab || ')' AS descripcion,
         'ALTA' AS severidad
  FROM sh WHERE electores_habilitados > 0 AND ref_hab > 0 AND electores_habilitados <> ref_hab
  UNION ALL
  SELECT k, acta_id, 'DATOS_CONTRADICTORIOS',
         'Total votos (' || total_votos || ') supera votantes habilitados (' || ref_hab || ')', 'CRITICA'
  FROM sh WHERE ref_hab > 0 AND total_votos > ref_hab
  UNION ALL
  SELECT k, acta_id, 'DATOS_CONTRADICTORIOS',
         'Papeletas en ánfora reportadas (' || anfora_reportada || ') ≠ transcripción oficial (' || ref_anfora || ')', 'ALTA'
  FROM sh WHERE ref_anfora > 0 AND anfora_reportada > 0 AND anfora_reportada <> ref_anfora"""

_MISSING = """
  SELECT k, acta_id, 'FALTA_APERTURA_CIERRE' AS tipo,
         'Falta hora de apertura de la jornada electoral en el acta' AS descripcion, 'MEDIA' AS severidad
  FROM sh WHERE apertura_hora IN ('', '0')
  UNION ALL
  SELECT k, acta_id, 'FALTA_APERTURA_CIERRE', 'Falta hora de cierre de la jornada electoral en el acta', 'MEDIA'
  FROM sh WHERE cierre_hora IN ('', '0')"""

_LOG = f""",
log0 AS ({_ARITHMETIC} UNION ALL {_CONTRADICTORY} UNION ALL {_MISSING}),
log AS (
  SELECT log0.*, CASE WHEN tipo_entrada = 'SMS' THEN 'SMS' ELSE 'UPLOAD' END AS fuente, fecha_recepcion AS fecha
  FROM log0 JOIN (SELECT k, tipo_entrada, fecha_recepcion FROM sh) s USING (k))"""

_EVENTS = """,
evt AS (
  SELECT event_id, 'MESA-' || (user_id + 1010200000000) AS acta_id, event_type AS tipo_evento,
         props AS descripcion, ts AS fecha FROM events)"""

_MESSAGES = """,
msg0 AS (
  SELECT rep.*, copia, k * 4 + copia AS seq, 'MESA-' || codigo_acta AS acta_id,
         CASE WHEN copia = 2 THEN 2 ELSE 0 END AS corr,
         CASE WHEN k % 35 = 0 AND copia = 0 THEN '+59199999999' ELSE '+5917000000' || (k % 7) END AS telefono,
         fecha_recepcion + to_seconds(CASE copia WHEN 1 THEN 600 WHEN 2 THEN 7200 ELSE 0 END) AS llegada,
         CASE WHEN k % 47 = 0 THEN 'campo mal formado: ''REC ' || recinto || '''' END AS m1,
         CASE WHEN k % 45 = 0 THEN 'campo obligatorio faltante: VAL (votos válidos)' END AS m2,
         CASE WHEN k % 49 = 0 THEN 'NUL (votos nulos) no es número: ''x' || votos_nulos || '''' END AS m3,
         CASE WHEN k % 51 = 0 THEN 'candidato C3 faltante en la secuencia' END AS m4
  FROM rep CROSS JOIN (VALUES (0), (1), (2)) c(copia)
  WHERE tipo_entrada = 'SMS' AND (copia = 0 OR (copia = 1 AND k % 20 = 0) OR (copia = 2 AND k % 55 = 0))),
msg1 AS (
  SELECT *, concat_ws(' | ', m1, m2, m3, m4) AS errores, concat_ws('; ', m1, m2, m3, m4) AS errores_pc,
         CAST((m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT + (m4 IS NOT NULL)::INT AS INTEGER) AS n_errores,
         CASE WHEN k % 45 = 0 THEN 0 ELSE votos_validos + corr END AS val,
         CASE WHEN k % 49 = 0 THEN 0 ELSE votos_nulos END AS nul,
         CASE WHEN k % 51 = 0 THEN 0 ELSE P3 END AS v3,
         c1 + corr AS v1,
         CASE WHEN k % 43 = 0 THEN ' ' ELSE '' END AS sp
  FROM msg0),
msg AS (
  SELECT *, CASE WHEN k % 35 = 0 AND copia = 0 THEN 'TELEFONO' WHEN copia = 1 THEN 'HASH'
                 WHEN n_errores > 0 THEN 'FORMATO' WHEN k % 30 = 0 THEN 'PIN' ELSE 'ACTA' END AS etapa,
         val + nul + votos_blancos AS total
  FROM msg1),
jud AS (
  SELECT *, CASE WHEN etapa IN ('TELEFONO', 'PIN') THEN 'RECHAZADO' WHEN etapa = 'FORMATO' THEN 'ERROR'
                 WHEN etapa = 'ACTA' AND copia = 2 AND k % 35 <> 0 THEN 'DUPLICADO'
                 WHEN etapa = 'ACTA' THEN 'PROCESADO' END AS estado_sms
  FROM msg),
smi AS (
  SELECT seq, acta_id, 'INCONSISTENCIA_ARITMETICA' AS tipo, 'CRITICA' AS severidad,
         'Suma de votos por candidatos (' || (v1 + P2 + v3 + P4) || ') no coincide con votos válidos (' || val || ')' AS descripcion
  FROM jud WHERE etapa = 'ACTA' AND val > 0 AND v1 + P2 + v3 + P4 <> val
  UNION ALL
  SELECT seq, acta_id, 'DATOS_CONTRADICTORIOS', 'CRITICA',
         'Total votos (' || total || ') supera votantes habilitados (' || votantes_habilitados || ')'
  FROM jud WHERE etapa = 'ACTA' AND votantes_habilitados > 0 AND total > votantes_habilitados
  UNION ALL
  SELECT seq, acta_id, 'FALTA_APERTURA_CIERRE', 'MEDIA', 'Falta hora de apertura de la jornada electoral en el acta'
  FROM jud WHERE etapa = 'ACTA' AND apertura_hora = '0'
  UNION ALL
  SELECT seq, acta_id, 'DUPLICADO_DATOS_DIFERENTES', 'CRITICA',
         'Acta recibida con anterioridad y datos no coinciden: votos_validos: anterior=' || (val - 2) || ', nuevo=' || val
  FROM jud WHERE estado_sms = 'DUPLICADO'),
smuni AS (
  SELECT departamento AS "Departamento", municipio AS "Municipio", CAST(sum(total) AS BIGINT) AS "VotantesHabilitados",
         CAST(sum(val) AS BIGINT) AS "VotosValidos", CAST(sum(votos_blancos) AS BIGINT) AS "VotosBlancos",
         CAST(sum(nul) AS BIGINT) AS "VotosNulos", CAST(sum(v1) AS BIGINT) AS "P1", CAST(sum(P2) AS BIGINT) AS "P2",
         CAST(sum(v3) AS BIGINT) AS "P3", CAST(sum(P4) AS BIGINT) AS "P4"
  FROM jud WHERE estado_sms = 'PROCESADO' GROUP BY 1, 2)"""

# The message text itself, for the hash only.
_MESSAGE_TEXT = """,
txt AS (
  SELECT seq, k, copia, telefono, llegada, concat_ws('|',
    CASE WHEN k % 43 = 0 THEN ' acta ' ELSE 'ACTA' END || ':' || acta_id,
    CASE WHEN k % 43 = 0 THEN ' dep ' ELSE 'DEP' END || ':' || departamento,
    CASE WHEN k % 43 = 0 THEN ' mun ' ELSE 'MUN' END || ':' || municipio,
    CASE WHEN k % 47 = 0 THEN 'REC ' || recinto ELSE CASE WHEN k % 43 = 0 THEN ' rec ' ELSE 'REC' END || ':' || recinto END,
    CASE WHEN k % 43 = 0 THEN ' mesa ' ELSE 'MESA' END || ':' || nro_mesa,
    CASE WHEN k % 45 <> 0 THEN CASE WHEN k % 43 = 0 THEN ' val ' ELSE 'VAL' END || ':' || (votos_validos + corr) END,
    CASE WHEN k % 43 = 0 THEN ' nul ' ELSE 'NUL' END || ':' || CASE WHEN k % 49 = 0 THEN 'x' ELSE '' END || votos_nulos,
    CASE WHEN k % 43 = 0 THEN ' bla ' ELSE 'BLA' END || ':' || votos_blancos,
    CASE WHEN k % 43 = 0 THEN ' c1 ' ELSE 'C1' END || ':' || v1,
    CASE WHEN k % 43 = 0 THEN ' c2 ' ELSE 'C2' END || ':' || P2,
    CASE WHEN k % 51 <> 0 THEN CASE WHEN k % 43 = 0 THEN ' c3 ' ELSE 'C3' END || ':' || P3 END,
    CASE WHEN k % 43 = 0 THEN ' c4 ' ELSE 'C4' END || ':' || P4,
    CASE WHEN k % 43 = 0 THEN ' pin ' ELSE 'PIN' END || ':' || CASE WHEN k % 30 = 0 THEN '0000' ELSE '4821' END) AS mensaje_raw
  FROM msg)"""

_FILES = """,
fil0 AS (
  SELECT rep.* EXCLUDE (fecha_recepcion), copia, k * 4 + copia AS seq, CASE WHEN copia = 2 THEN 2 ELSE 0 END AS corr,
         tipo_entrada = 'PDF' AS pdf,
         CASE WHEN k % 19 = 0 THEN 'scan_' || k ELSE 'acta_' || codigo_acta END
           || CASE WHEN copia = 2 THEN '_v2' ELSE '' END || '.pdf' AS file_name,
         fecha_recepcion + to_seconds(CASE copia WHEN 1 THEN 900 WHEN 2 THEN 1800 ELSE 0 END) AS llegada,
         greatest(papeletas_no_utilizadas, 0) AS sin_usar
  FROM rep CROSS JOIN (VALUES (0), (1), (2)) c(copia)
  WHERE tipo_entrada <> 'SMS' AND (copia = 0 OR (copia = 1 AND k % 22 = 0) OR (copia = 2 AND k % 44 = 0))),
fil1 AS (
  SELECT *, CASE WHEN k % 17 <> 0 OR k % 19 <> 0 THEN CAST(codigo_acta AS VARCHAR) ELSE '' END AS f_codigo,
         CASE WHEN pdf THEN k % 83 = 0 ELSE k % 29 = 0 END AS sin_tripletes
  FROM fil0),
fil2 AS (
  SELECT *,
    CASE WHEN pdf THEN CASE WHEN k % 17 <> 0 AND k % 23 <> 0 THEN CAST(nro_mesa AS VARCHAR)
                            WHEN f_codigo <> '' THEN CAST(codigo_acta % 1000 AS VARCHAR) ELSE '' END
         ELSE CAST(nro_mesa AS VARCHAR) END AS f_mesa,
    CASE WHEN pdf OR k % 31 <> 0 THEN departamento WHEN departamento = 'Exterior' THEN '' ELSE departamento END AS f_dep,
    CASE WHEN pdf THEN municipio ELSE 'NATION' END AS f_mun,
    CASE WHEN pdf THEN 'Calle ' || recinto ELSE recinto END AS f_rec,
    CASE WHEN sin_tripletes AND pdf THEN 0 ELSE votos_validos + corr END AS f_val,
    CASE WHEN sin_tripletes AND pdf THEN 0 ELSE votos_blancos END AS f_bla,
    CASE WHEN sin_tripletes THEN 0 ELSE votos_nulos END AS f_nul,
    CASE WHEN sin_tripletes THEN 0 ELSE votantes_habilitados END AS f_hab,
    CASE WHEN sin_tripletes THEN 0 ELSE papeletas_anfora END AS f_anf,
    CASE WHEN sin_tripletes THEN 0 ELSE sin_usar END AS f_sin,
    CASE WHEN sin_tripletes AND pdf THEN NULL ELSE c1 + corr END AS f_c1,
    CASE WHEN sin_tripletes AND pdf THEN NULL ELSE P2 END AS f_c2,
    CASE WHEN sin_tripletes AND pdf THEN NULL ELSE P3 END AS f_c3,
    CASE WHEN sin_tripletes AND pdf THEN NULL WHEN sin_tripletes THEN 0 ELSE P4 END AS f_c4
  FROM fil1),
fil AS (
  SELECT *, CASE WHEN f_codigo <> '' THEN 'MESA-' || f_codigo WHEN f_mesa <> '' THEN 'MESA-' || f_mesa
                 ELSE 'MESA-DESCONOCIDA-' || file_name END AS acta_id,
         f_val + f_bla + f_nul AS f_total, coalesce(f_c1 + f_c2 + f_c3 + f_c4, 0) AS f_suma
  FROM fil2),
up0 AS (SELECT *, row_number() OVER (PARTITION BY acta_id ORDER BY llegada, seq) AS rn FROM fil),
kept AS (SELECT acta_id, k AS pk, copia AS pcopia, f_val AS pv, f_nul AS pn, f_bla AS pb, f_dep AS pd FROM up0 WHERE rn = 1),
up AS (
  SELECT up0.*, pv, pn, pb, pd,
    CASE WHEN rn = 1 THEN 'GUARDADA' WHEN pk = k AND (pcopia = 2) = (copia = 2) THEN 'DUPLICADO_HASH'
         ELSE 'DUPLICADO_ACTA' END AS resultado,
    f_mun = '' OR f_dep = '' OR f_mesa = '' OR f_c1 IS NULL OR (f_val > 0 AND f_suma <> f_val AND f_c1 IS NOT NULL)
      OR (f_hab > 0 AND f_total > f_hab) AS con_errores,
    CASE WHEN k % 37 = 0 OR (f_hab > 0 AND f_total > f_hab) THEN 'ANULADA'
         WHEN f_mun = '' OR f_dep = '' OR f_mesa = '' OR f_c1 IS NULL OR (f_val > 0 AND f_suma <> f_val) THEN 'ERROR'
         ELSE 'PROCESADA' END AS estado,
    (f_val > 0 AND f_c1 IS NOT NULL AND f_suma <> f_val)
      OR (f_codigo <> '' AND ((votantes_habilitados > 0 AND f_total > votantes_habilitados) OR apertura_hora = '0'))
      OR (rn > 1 AND (pv <> f_val OR pn <> f_nul OR pb <> f_bla OR (f_dep <> '' AND pd <> f_dep))) AS con_inc
  FROM up0 JOIN kept USING (acta_id))"""

def _drawn(value: str) -> str:
    """Three digits at least with blanks between them, some as look-alikes."""
    spaced = f"trim(regexp_replace({_three(value)}, '(.)', '\\1 ', 'g'))"
    return f"CASE WHEN k % 13 = 0 THEN translate({spaced}, '0158', 'OlSB') ELSE {spaced} END"


def _three(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(length({text}), 3) AS INTEGER), '0')"


_ADMIN = ["votantes_habilitados", "papeletas_anfora", "sin_usar"]
_VOTES = ["c1 + corr", "P2", "P3", "P4"]
_TOTALS = ["votos_validos + corr", "votos_blancos", "votos_nulos"]


def _unless(condition: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN NOT ({condition}) THEN {v} END" for v in values)


# The text of each file, for sizes and hashes only.
_FILE_TEXT = f""",
ftx AS (
  SELECT seq, k, codigo_recinto, departamento, file_name, CASE WHEN pdf THEN concat_ws(chr(10),
    '--- FUENTE: TEXTO_EMBEBIDO ---', departamento, provincia, municipio, 'Local', 'Calle ' || recinto, '',
    CASE WHEN k % 17 <> 0 THEN CAST(codigo_acta AS VARCHAR) END, ' ', CASE WHEN k % 23 <> 0 THEN CAST(nro_mesa AS VARCHAR) END,
    CASE WHEN k % 37 = 0 THEN 'ANULADA' END, {", ".join(map(_drawn, _ADMIN))},
    {_unless("k % 83 = 0", list(map(_drawn, _VOTES)))}, {", ".join(map(_drawn, _TOTALS))})
  ELSE concat_ws(chr(10), 'ACTA DE ESCRUTINIO Y CONTEO',
    CASE WHEN k % 17 <> 0 THEN 'CÓDIGO DE MESA: ' || codigo_acta END, 'NÚMERO DE MESA: ' || nro_mesa,
    CASE WHEN k % 31 <> 0 THEN 'Departamento : ' || departamento END, 'Provincia : ' || provincia,
    'Municipio : ' || replace(municipio, '_', ' '), 'Localidad : Centro', 'Recinto : ' || recinto,
    CASE WHEN k % 31 = 0 THEN 'Jurado de ' || departamento END, CASE WHEN k % 37 = 0 THEN 'ANULADA' END,
    {_unless("k % 29 = 0", [f"'dato: ' || ({_drawn(v)})" for v in _ADMIN])},
    {_unless("k % 29 = 0", [f"'casilla: ' || ({_drawn(v)})" for v in _VOTES])},
    {_unless("k % 29 = 0", [f"'total: ' || ({_drawn(v)})" for v in _TOTALS])},
    {_unless("k % 29 <> 0", ["'DAENERYS TARGARYEN : ' || " + _three(_VOTES[0]), "'Sansa Stork ' || " + _three("P2"),
                             "'Robert BARATHEON  ' || " + _three("P3"), "'VOTOS VÁLIDOS: ' || " + _three(_TOTALS[0]),
                             "'VOTOS BLANCOS: ' || " + _three("votos_blancos")])}) END AS texto
  FROM fil)"""

_IMAGES = """,
dens AS (SELECT l_orderkey AS k, max(l_quantity) / 100.0 AS max_cell_density FROM lineitem GROUP BY 1),
img AS (
  SELECT o_orderkey AS k, 'MESA-' || (o_orderkey + 1010200000000) AS acta_id,
         o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS prog,
         CAST(o_orderkey * 7 % 11 AS DOUBLE) / 10 AS gray, CAST(o_orderkey * 3 % 23 AS DOUBLE) AS black,
         coalesce(max_cell_density, 0) AS ink, CAST(o_orderkey * 13 % 50 AS DOUBLE) / 10 AS stain,
         CAST(o_orderkey * 5 % 29 AS DOUBLE) AS corner, CAST(o_orderkey * 11 % 37 AS DOUBLE) / 100 AS shadow,
         CAST(o_orderkey * 17 % 70 AS DOUBLE) / 100 AS blank, o_orderkey * 101 % 8000 AS px,
         CAST(o_orderkey * 19 % 25 AS DOUBLE) / 10 AS pre_stain, CAST(o_orderkey * 29 % 60 AS DOUBLE) / 1000 AS pre_print
  FROM orders LEFT JOIN dens ON o_orderkey = k),
cel AS (
  SELECT DISTINCT l_orderkey AS k, l_partkey % 14 + 1 AS fila, l_linenumber % 3 + 1 AS columna FROM lineitem
  WHERE l_quantity / 100.0 > 0.38 OR l_suppkey % 8 >= 6),
celk AS (
  SELECT k, string_agg('fila' || fila || '_col' || columna, ' | ' ORDER BY fila, columna) AS celdas, count(*) AS n FROM cel GROUP BY k),
flg AS (
  SELECT k, acta_id, coalesce(prog AND gray > 0.4 AND gray < 0.9, FALSE) AS lapiz_detectado,
         CASE WHEN prog AND gray > 0.4 AND gray < 0.9 THEN gray * 255 ELSE 0.0 END AS intensidad_promedio,
         CASE WHEN prog AND gray > 0.4 AND gray < 0.9 THEN 1.0 - gray ELSE 0.0 END AS ratio_contraste,
         stain > 3.0 OR corner > 20.0 AS mancha_detectada,
         CASE WHEN NOT stain > 3.0 AND corner > 20.0 THEN round(corner * 10) / 10 ELSE round(stain * 10) / 10 END AS porcentaje_mancha,
         CAST(least(12, px // 500) AS INTEGER) AS huellas_detectadas, least(12, px // 500) >= 3 AS firmas_suficientes,
         FALSE AS corrector_detectado, NOT prog AND ink > 0.45 AS tachadura_detectada, blank > 0.60 AS rotura_detectada,
         NOT prog AND black > 15.0 AS texto_anulada_visual, shadow > 0.25 AS arrugas_detectadas
  FROM img),
pre AS (
  SELECT img.k, acta_id, pre_stain > 1.5 AS mancha_detectada, pre_stain AS porcentaje_mancha, celdas IS NOT NULL AS numeros_sobreescritos,
         coalesce(celdas, '') AS celdas_sobreescritas, img.k % 26 = 0 AS confusion_alfanumerica,
         CASE WHEN img.k % 26 = 0 THEN 'mesa=''1X''→''1?''' ELSE '' END AS campos_sospechosos,
         pre_print > 0.04 AS huellas_zona_numeros,
         pre_stain > 1.5 OR celdas IS NOT NULL OR img.k % 26 = 0 OR pre_print > 0.04 AS flag_revision_manual
  FROM img LEFT JOIN celk ON img.k = celk.k)"""


def _with(body: str, *parts: str) -> str:
    return "WITH " + _BASE.lstrip() + "".join(parts) + "\n" + body.strip()


def _base(body):
    return _with(body)


def _quick(body):
    return _with(body, _QUICK)


def _log(body):
    return _with(body, _QUICK, _LOG)


def _events(body):
    return _with(body, _QUICK, _LOG, _EVENTS)


def _messages(body):
    return _with(body, _QUICK, _MESSAGES)


def _files(body):
    return _with(body, _QUICK, _FILES)


def _submitted(body):
    return _with(body, _SUBMITTED)


def _images(body):
    return _with(body, _IMAGES)


_TURNOUT = ("CASE WHEN \"VotantesHabilitados\" <> 0 THEN "
            "round_even(\"VotosValidos\" / \"VotantesHabilitados\" * 100 * 10, 0) / 10 ELSE 0.0 END")
_WINNER = ("CASE greatest(\"P1\", \"P2\", \"P3\", \"P4\") WHEN \"P1\" THEN 'P1' WHEN \"P2\" THEN 'P2' "
           "WHEN \"P3\" THEN 'P3' ELSE 'P4' END")
_PARTY = ("CASE {} WHEN 'P1' THEN 'Partido 1 (MAS-IPSP)' WHEN 'P2' THEN 'Partido 2 (CC)' "
          "WHEN 'P3' THEN 'Partido 3 (FPV)' WHEN 'P4' THEN 'Partido 4 (APB)' END")
_SUMS = ", ".join(f"CAST(sum({p}) AS BIGINT) AS {p}" for p in ("P1", "P2", "P3", "P4"))
_NATIONAL = ", ".join(
    f'CAST(coalesce(sum("{m}"), 0) AS BIGINT) AS "{m}"'
    for m in ("VotantesHabilitados", "VotosValidos", "VotosBlancos", "VotosNulos", "P1", "P2", "P3", "P4"))


def _pct(a, b):
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} * 100 ELSE 0.0 END"


_BREAKDOWN = """
  SELECT 'estado' AS grupo, estado AS clave, count(*) AS cantidad FROM sh GROUP BY 2
  UNION ALL SELECT 'departamento', departamento, count(*) FROM sh GROUP BY 2
  UNION ALL SELECT 'tipo_entrada', tipo_entrada, count(*) FROM sh GROUP BY 2
  UNION ALL SELECT 'votos', 'votos_validos', CAST(sum(votos_validos) AS BIGINT) FROM good
  UNION ALL SELECT 'votos', 'votos_nulos', CAST(sum(votos_nulos) AS BIGINT) FROM good
  UNION ALL SELECT 'votos', 'votos_blancos', CAST(sum(votos_blancos) AS BIGINT) FROM good
  UNION ALL SELECT 'candidato', candidato_id, votos FROM cand"""

_MARGIN = """(SELECT CASE WHEN v <> 0 THEN round((a - b) / v * 100 * 100) / 100 ELSE 0.0 END
  FROM (SELECT (SELECT sum(votos_validos) FROM good) AS v, (SELECT max(votos) FROM cand) AS a,
               (SELECT votos FROM cand ORDER BY votos DESC LIMIT 1 OFFSET 1) AS b))"""

_SNAPSHOT = f"""
  SELECT n1 AS total_actas_procesadas, n2 AS total_actas_error, n3 AS total_actas_anuladas, n4 AS total_actas_observadas,
         v AS total_votos_validos, nu AS total_votos_nulos, b AS total_votos_blancos, esp AS total_actas_esperadas,
         hab AS total_habilitados, inc AS total_inconsistencias, v + nu + b AS total_votantes,
         CASE WHEN esp > 0 THEN round((n1 + n2 + n3 + n4) / esp * 10000) / 100 ELSE 0.0 END AS porcentaje_avance,
         CASE WHEN hab > 0 THEN round((v + nu + b) / hab * 10000) / 100 ELSE 0.0 END AS tasa_participacion,
         {_MARGIN} AS margen_victoria
  FROM (SELECT count(*) FILTER (estado = 'PROCESADA') AS n1, count(*) FILTER (estado = 'ERROR') AS n2,
               count(*) FILTER (estado = 'ANULADA') AS n3, count(*) FILTER (estado = 'OBSERVADA') AS n4 FROM sh),
       (SELECT CAST(sum(votos_validos) AS BIGINT) AS v, CAST(sum(votos_nulos) AS BIGINT) AS nu,
               CAST(sum(votos_blancos) AS BIGINT) AS b FROM good),
       (SELECT count(*) AS esp, CAST(sum(votantes_habilitados) AS BIGINT) AS hab FROM tal),
       (SELECT count(*) AS inc FROM log)"""

_SHEET = "acta_id, departamento, tipo_entrada, estado, fecha_recepcion"

ORACLE: dict[str, str] = {
    # sources
    "src_territory": _base("SELECT codigo_territorial, departamento, 'Provincia' AS provincia, municipio FROM terr"),
    "src_precincts": _base(
        "SELECT codigo_recinto, CAST(codigo_territorial AS BIGINT) AS codigo_territorial, recinto, "
        "'Calle, ' || provincia AS direccion, CAST(1 AS BIGINT) AS num_mesas FROM prec"),
    "src_mesas": _base(
        "SELECT codigo_recinto, codigo_acta, nro_mesa, votantes_habilitados FROM tal WHERE k % 64 <> 0"),
    "src_transcriptions": _base("""
SELECT codigo_acta, codigo_recinto, CAST(nro_mesa AS BIGINT) AS nro_mesa, P1 AS p1, P2 AS p2,
       CASE WHEN k % 32 = 0 THEN 0 ELSE P3 END AS p3, P4 AS p4, votos_validos, votos_blancos, votos_nulos,
       papeletas_anfora, papeletas_no_utilizadas, CAST(0 AS BIGINT) AS apertura_minutos, CAST(0 AS BIGINT) AS cierre_minutos,
       CAST(8 AS BIGINT) AS apertura_hora, CAST(CASE WHEN k % 16 = 0 THEN 16 ELSE 17 END AS BIGINT) AS cierre_hora,
       'corre y vale, sí' AS observaciones
FROM tal WHERE k % 64 <> 0"""),
    "src_sms": _with("SELECT telefono, mensaje_raw, llegada AS fecha_recepcion, seq FROM txt", _QUICK, _MESSAGES, _MESSAGE_TEXT),
    "src_sheet_texts": _with(
        "SELECT seq, file_name, CAST(strlen(texto) AS BIGINT) AS bytes, sha256(texto) AS hash_origen FROM ftx",
        _QUICK, _FILES, _FILE_TEXT),
    "file_inventory": """
SELECT file_name, extension, sha256(html) AS hash_origen, CAST(strlen(html) AS BIGINT) AS bytes
FROM (SELECT html, ext AS extension, 'page_' || page_id || ext AS file_name
      FROM (SELECT html, page_id, CASE page_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png'
            WHEN 3 THEN '.pdf' WHEN 4 THEN '.txt' WHEN 5 THEN '.tiff' ELSE '' END AS ext FROM pages))
WHERE extension IN ('.jpg', '.jpeg', '.png', '.pdf', '.bmp', '.tiff')""",
    "placeholder_row": _base("""
SELECT * FROM dept WHERE "VotosValidos" < 0
UNION ALL SELECT 'Sin Datos', 1, 0, 0, 0, 0, 0, 0, 0 WHERE NOT EXISTS (SELECT * FROM dept WHERE "VotosValidos" < 0)"""),
    "placeholder_row_not_needed": _base("SELECT * FROM dept"),
    "limit_scan": _base("SELECT least(100, count(*)) AS filas FROM tr"),
    # sinks
    "insert_if_absent": _submitted("""
SELECT fila, codigo_acta FROM (SELECT fila, codigo_acta, row_number() OVER (PARTITION BY codigo_acta ORDER BY fila) AS rn FROM sub)
WHERE rn = 1 AND codigo_acta NOT IN (SELECT codigo_acta FROM done)"""),
    "official_votes_long": _submitted("""
SELECT codigo_acta, i AS id_partido, CASE i WHEN 1 THEN P1 WHEN 2 THEN P2 WHEN 3 THEN P3 ELSE P4 END AS cantidad_votos
FROM rul CROSS JOIN (VALUES (1), (2), (3), (4)) x(i) WHERE motivo IS NULL"""),
    "rejected_rows": _submitted("""
SELECT fila, codigo_acta, motivo FROM (
  SELECT fila, codigo_acta, CASE
    WHEN papeletas_no_utilizadas < 0 THEN 'campo "PapeltasNoUtilizadas" es negativo (' || papeletas_no_utilizadas || ')'
    WHEN P1 + P2 + P3 + P4 <> votos_validos THEN 'P1+P2+P3+P4 (' || (P1 + P2 + P3 + P4) || ') ≠ VotosValidos (' || votos_validos || ')'
    WHEN votos_validos + votos_blancos + votos_nulos <> papeletas_anfora
      THEN 'VotosValidos+Blancos+Nulos (' || (votos_validos + votos_blancos + votos_nulos) || ') ≠ PapeletasAnfora (' || papeletas_anfora || ')'
    END AS motivo FROM sub) WHERE motivo IS NOT NULL"""),
    # lookups
    "list_sheets": _quick(f"SELECT {_SHEET} FROM sh WHERE departamento = 'La Paz' AND estado = 'PROCESADA' AND tipo_entrada = 'PDF'"),
    "get_sheet": _quick(f"SELECT {_SHEET}, votos_validos, total_votos FROM sh WHERE k = 12"),
    "list_all_sheets": _quick(f"SELECT {_SHEET} FROM sh"),
    "find_mesa_by_code": _base("""
SELECT codigo_acta, recinto, departamento, municipio, nro_mesa, votantes_habilitados FROM tr
WHERE k = 7 AND codigo_acta NOT IN (SELECT codigo_acta FROM done)"""),
    "find_mesa_by_place": _base("""
SELECT codigo_acta, recinto, departamento, municipio, nro_mesa, votantes_habilitados FROM
  (SELECT * FROM tr WHERE codigo_recinto = 7 AND nro_mesa = 8 ORDER BY codigo_acta LIMIT 1)
WHERE codigo_acta NOT IN (SELECT codigo_acta FROM done)"""),
    "find_mesa_transcribed": _base("""
SELECT codigo_acta, codigo_recinto, nro_mesa, votantes_habilitados FROM tal
WHERE k = 3 AND codigo_acta IN (SELECT codigo_acta FROM done)"""),
    "get_by_hash": _quick(f"SELECT {_SHEET} FROM sh WHERE k = 12"),
    "latest_events": _events("SELECT * FROM evt ORDER BY fecha DESC, event_id DESC LIMIT 500"),
    "latest_sms": _messages("SELECT seq, telefono, llegada AS fecha_recepcion FROM msg ORDER BY llegada DESC, seq DESC LIMIT 500"),
    "latest_inconsistencies": _log("""
SELECT acta_id, tipo, severidad, fecha, fuente, descripcion FROM log
ORDER BY fecha DESC, concat_ws('/', acta_id, tipo, descripcion) DESC LIMIT 500"""),
    "events_of_sheet": _events("SELECT * FROM evt WHERE acta_id = 'MESA-1010200000001'"),
    "count_by_state": _quick("""
SELECT count(*) FILTER (estado = 'PROCESADA') AS procesada, count(*) FILTER (estado = 'ERROR') AS error,
       count(*) FILTER (estado = 'ANULADA') AS anulada, count(*) FILTER (estado = 'OBSERVADA') AS observada FROM sh"""),
    "q06_annulled_sheets": _quick("""
SELECT acta_id AS id_boleta, recinto, CAST(nro_mesa AS VARCHAR) AS mesa, motivo_estado AS motivo_anulacion
FROM sh WHERE estado = 'ANULADA'"""),
    "q11_high_abstention": _base("""
SELECT * FROM (
  SELECT departamento, recinto, nro_mesa, codigo_acta, votantes_habilitados, papeletas_anfora AS votos_emitidos,
         CASE WHEN votantes_habilitados > 0 THEN (votantes_habilitados - papeletas_anfora) / votantes_habilitados * 100
              ELSE 0.0 END AS abstencion_pct FROM tr) WHERE abstencion_pct > 20.0"""),
    "find_untranscribed_mesa": _base("""
SELECT codigo_acta, recinto, departamento, municipio, nro_mesa, votantes_habilitados FROM tr
WHERE codigo_acta NOT IN (SELECT codigo_acta FROM done)"""),
    "lookup_reference": _base("SELECT codigo_acta, recinto, votantes_habilitados, papeletas_anfora FROM tr WHERE k = 7"),
    "numeric_code": """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'MESA-' || o_orderkey WHEN 1 THEN 'MESA- ' || o_orderkey || chr(9)
            ELSE 'ACTA-' || o_orderkey END AS acta_id,
       CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey ELSE 0 END AS codigo FROM orders""",
    "mesas_projection": _base("""
SELECT codigo_acta AS "CodigoMesa", nro_mesa AS "NroMesa", votantes_habilitados AS "CantidadHabilitada",
       codigo_recinto AS "CodigoRecintoElectoral" FROM tal"""),
    "party_names": _base("""
SELECT codigo, votos, CASE codigo WHEN 'C1' THEN 'Daenerys Targaryen' WHEN 'C2' THEN 'Sansa Stark'
       WHEN 'C3' THEN 'Robert Baratheon' WHEN 'C4' THEN 'Tyrion Lannister' ELSE codigo END AS candidato
FROM (SELECT 'C' || id_partido AS codigo, CAST(sum(cantidad_votos) AS BIGINT) AS votos FROM vl GROUP BY 1)"""),
    "sheet_valid_share": _quick("""
SELECT acta_id, votos_validos, total, CASE WHEN total > 0 THEN round(votos_validos / total * 100, 1) ELSE 0.0 END AS pct_validos
FROM (SELECT acta_id, votos_validos, CASE WHEN k % 8 = 0 OR total_votos = 0 THEN votos_validos + votos_blancos + votos_nulos
             ELSE total_votos END AS total FROM sh)"""),
    # joins
    "official_by_municipality": _base("SELECT * FROM muni"),
    "q17_department_gap": _quick("""
SELECT departamento, trep_actas, trep_votos_validos, coalesce(o, 0) AS oficial_votos_validos,
       trep_votos_validos - coalesce(o, 0) AS diferencia_votos, trep_votos_validos <> coalesce(o, 0) AS tiene_inconsistencia
FROM (SELECT CASE WHEN k % 77 = 0 THEN 'Tarija' ELSE departamento END AS departamento, count(*) AS trep_actas,
             CAST(sum(votos_validos) AS BIGINT) AS trep_votos_validos FROM sh GROUP BY 1)
LEFT JOIN (SELECT departamento, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS o FROM tr GROUP BY 1) USING (departamento)"""),
    "q07_q08_quick_vs_official": _quick("""
SELECT medida, CAST(trep AS BIGINT) AS trep, CAST(oficial AS BIGINT) AS oficial, CAST(trep - oficial AS BIGINT) AS diferencia FROM (
  SELECT 'totales' AS medida, (SELECT sum(votos_validos + votos_nulos + votos_blancos) FROM good) AS trep,
         (SELECT sum(votos_validos + votos_nulos + votos_blancos) FROM tr) AS oficial
  UNION ALL SELECT 'votos_validos', (SELECT sum(votos_validos) FROM good), (SELECT sum(votos_validos) FROM tr)
  UNION ALL SELECT 'votos_nulos', (SELECT sum(votos_nulos) FROM good), (SELECT sum(votos_nulos) FROM tr)
  UNION ALL SELECT 'votos_blancos', (SELECT sum(votos_blancos) FROM good), (SELECT sum(votos_blancos) FROM tr)
  UNION ALL SELECT 'P1', (SELECT sum(c1) FROM good), (SELECT sum(P1) FROM tr)
  UNION ALL SELECT 'P2', (SELECT sum(P2) FROM good), (SELECT sum(P2) FROM tr)
  UNION ALL SELECT 'P3', (SELECT sum(P3) FROM good), (SELECT sum(P3) FROM tr)
  UNION ALL SELECT 'P4', (SELECT sum(P4) FROM good), (SELECT sum(P4) FROM tr))"""),
    "department_map": _base("""
SELECT "Departamento", "P1" AS "Votos", lat, lon FROM dept
JOIN (VALUES ('Chuquisaca', -19.0333::DOUBLE, -65.2627::DOUBLE), ('La Paz', -16.4897, -68.1193),
             ('Cochabamba', -17.3936, -66.1570), ('Potosí', -19.5833, -65.7500)) c(d, lat, lon) ON d = "Departamento" """),
    "event_replay": _events("""
SELECT acta_id, 'evento' AS seccion, tipo_evento AS detalle, fecha FROM evt
UNION ALL SELECT acta_id, 'inconsistencia', tipo, fecha FROM log
UNION ALL SELECT acta_id, 'estado_actual', estado, fecha_recepcion FROM sh"""),
    "event_replay_one": _events("""
SELECT * FROM (SELECT acta_id, 'evento' AS seccion, tipo_evento AS detalle, fecha FROM evt
UNION ALL SELECT acta_id, 'inconsistencia', tipo, fecha FROM log
UNION ALL SELECT acta_id, 'estado_actual', estado, fecha_recepcion FROM sh) WHERE acta_id = 'MESA-1010200000001'"""),
    "event_replay_counts": _events("""
SELECT acta_id, CAST(sum(e) AS BIGINT) AS total_eventos, CAST(sum(i) AS BIGINT) AS total_inconsistencias,
       min(f) AS primer_evento, max(f) AS ultimo_evento, max(s) AS estado_actual
FROM (SELECT acta_id, 1 AS e, 0 AS i, fecha AS f, NULL AS s FROM evt
      UNION ALL SELECT acta_id, 0, 1, NULL, NULL FROM log
      UNION ALL SELECT acta_id, 0, 0, NULL, estado FROM sh) GROUP BY 1"""),
    "not_yet_transcribed": _base("""
SELECT codigo_acta, codigo_recinto, nro_mesa, votantes_habilitados FROM tal WHERE codigo_acta NOT IN (SELECT codigo_acta FROM done)"""),
    "already_transcribed": _base("""
SELECT codigo_acta, codigo_recinto, nro_mesa, votantes_habilitados FROM tal WHERE codigo_acta IN (SELECT codigo_acta FROM done)"""),
    # query bank
    "q01_mesas_per_precinct": _base("SELECT departamento, recinto, count(*) AS cantidad_mesas FROM tr GROUP BY 1, 2"),
    "q02_votes_by_municipality": _base("SELECT departamento, municipio, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr GROUP BY 1, 2"),
    "q03_votes_by_department": _base("SELECT departamento, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr GROUP BY 1"),
    "q04_top_precincts": _base("""
SELECT recinto, CAST(sum(P1) AS BIGINT) AS votos, 'P1' AS candidato FROM tr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
    "q05_null_votes": _base("""
SELECT departamento, n AS votos_nulos, v AS votos_validos, CASE WHEN v > 0 THEN n / v * 100 ELSE 0.0 END AS porcentaje_nulos
FROM (SELECT departamento, CAST(sum(votos_nulos) AS BIGINT) AS n, CAST(sum(votos_validos) AS BIGINT) AS v FROM tr GROUP BY 1)"""),
    "q12_sheets_per_hour": _quick("SELECT CAST(hour(fecha_recepcion) AS INTEGER) AS hora, count(*) AS actas_recibidas FROM sh GROUP BY 1"),
    "q14_arrival_span": _quick("""
SELECT departamento, min(fecha_recepcion) AS primera_acta, max(fecha_recepcion) AS ultima_acta,
       (epoch_ms(max(fecha_recepcion)) - epoch_ms(min(fecha_recepcion))) / 60000.0::DOUBLE AS tiempo_promedio_min FROM sh GROUP BY 1"""),
    "q16_turnout": _base("""
SELECT departamento, h AS votantes_habilitados, a AS votos_emitidos, CASE WHEN h > 0 THEN a / h * 100 ELSE 0.0 END AS participacion_pct
FROM (SELECT departamento, CAST(sum(votantes_habilitados) AS BIGINT) AS h, CAST(sum(papeletas_anfora) AS BIGINT) AS a FROM tr GROUP BY 1)"""),
    "q19_all": _base(f"SELECT departamento AS geo, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr GROUP BY 1"),
    "q19_department": _base(f"SELECT municipio AS geo, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr WHERE departamento = 'La Paz' GROUP BY 1"),
    "q19_municipality": _base(f"SELECT recinto AS geo, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr WHERE municipio = 'NATION_3' GROUP BY 1"),
    "q19_province": _base(f"SELECT provincia AS geo, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr WHERE provincia = 'MACHINERY' GROUP BY 1"),
    "q20_common_errors": _log("SELECT tipo AS tipo_error, count(*) AS frecuencia FROM log GROUP BY 1"),
    "inconsistency_total": _log("SELECT count(*) AS total FROM log"),
    "sheets_by_department": _quick("SELECT departamento, count(*) AS cantidad FROM sh GROUP BY 1"),
    "sheets_by_kind": _quick("SELECT tipo_entrada, count(*) AS cantidad FROM sh GROUP BY 1"),
    "quick_vote_totals": _quick("""
SELECT CAST(sum(votos_validos) AS BIGINT) AS votos_validos, CAST(sum(votos_nulos) AS BIGINT) AS votos_nulos,
       CAST(sum(votos_blancos) AS BIGINT) AS votos_blancos FROM good"""),
    "quick_votes_per_candidate": _quick("SELECT * FROM cand"),
    "official_totals": _base(f"""
SELECT {_SUMS}, CAST(sum(votos_validos) AS BIGINT) AS votos_validos, CAST(sum(votos_nulos) AS BIGINT) AS votos_nulos,
       CAST(sum(votos_blancos) AS BIGINT) AS votos_blancos, CAST(sum(votos_validos + votos_nulos + votos_blancos) AS BIGINT) AS total_votos FROM tr"""),
    "department_votes": _base(f"""
SELECT departamento, {_SUMS}, CAST(sum(votos_validos) AS BIGINT) AS total_votos_validos, CAST(sum(votos_nulos) AS BIGINT) AS total_votos_nulos,
       CAST(sum(votos_blancos) AS BIGINT) AS total_votos_blancos, 'Daenerys Targaryen' AS "candidato_P1", 'Sansa Stark' AS "candidato_P2",
       'Robert Baratheon' AS "candidato_P3", 'Tyrion Lannister' AS "candidato_P4" FROM tr GROUP BY 1"""),
    "reference_totals": _base("""
SELECT (SELECT count(*) FROM tal) AS total_actas_esperadas,
       (SELECT CAST(sum(votantes_habilitados) AS BIGINT) FROM tal) AS total_votantes_habilitados,
       (SELECT count(*) FROM prec) AS total_recintos,
       (SELECT string_agg(DISTINCT departamento, ', ' ORDER BY departamento) FROM terr) AS departamentos,
       (SELECT count(DISTINCT departamento) FROM terr) AS total_departamentos"""),
    "basic_stats": _quick(f"""
SELECT * FROM ({_BREAKDOWN}) WHERE grupo <> 'estado' OR clave IN ('PROCESADA', 'ERROR')
UNION ALL SELECT 'total', 'actas', count(*) FROM sh"""),
    "stats_breakdown": _log(f"{_BREAKDOWN} UNION ALL SELECT 'inconsistencia', tipo, count(*) FROM log GROUP BY 2"),
    "stats_snapshot": _log(_SNAPSHOT),
    "stats_full": _log(f"""
SELECT *, (SELECT count(*) FROM prec) AS total_recintos,
       total_actas_esperadas - total_actas_procesadas - total_actas_error - total_actas_anuladas - total_actas_observadas AS total_actas_pendientes,
       porcentaje_avance AS porcentaje_publicadas FROM ({_SNAPSHOT})"""),
    "victory_margin": _quick(f"SELECT {_MARGIN} AS margen_victoria"),
    "pivot_votes": _base("""
SELECT k + 1010200000000 AS codigo_acta, P1 AS "P1", P2 AS "P2", P3 AS "P3", P4 AS "P4" FROM piv"""),
    "official_by_department": _base("SELECT * FROM dept"),
    "dashboard_turnout": _base(f'SELECT "Departamento", "Municipio", {_TURNOUT} AS "Participacion" FROM muni'),
    "winner_by_department": _base(f"""
SELECT "Departamento", {_PARTY.format(_WINNER)} AS "Ganador", greatest("P1", "P2", "P3", "P4") AS "VotosGanador",
       {_TURNOUT} AS "Participacion", "VotosValidos" FROM dept"""),
    "national_totals": _base(f"""
SELECT *, {_WINNER} AS "GanadorCodigo", {_PARTY.format(_WINNER)} AS "Ganador",
       {", ".join(f'CASE WHEN "VotosValidos" > 0 THEN "{p}" / "VotosValidos" * 100 ELSE 0.0 END AS "pct_{p}"' for p in ("P1", "P2", "P3", "P4"))}
FROM (SELECT {_NATIONAL} FROM muni)"""),
    "sms_by_municipality": _messages("SELECT * FROM smuni"),
    "batch_summary": _quick(f"""
SELECT estado, motivo_estado AS motivo, n AS cantidad, {_pct("n", "total")} AS porcentaje
FROM (SELECT estado, motivo_estado, count(*) AS n FROM sh GROUP BY 1, 2), (SELECT count(*) AS total FROM sh)"""),
    "batch_candidates": _quick("""
SELECT CASE candidato_id WHEN 'C1' THEN 'Daenerys Targaryen' WHEN 'C2' THEN 'Sansa Stark' WHEN 'C3' THEN 'Robert Baratheon'
            ELSE 'Tyrion Lannister' END AS candidato, votos, CASE WHEN v > 0 THEN votos / v * 100 ELSE 0.0 END AS porcentaje
FROM cand, (SELECT CAST(sum(votos_validos) AS BIGINT) AS v FROM good)"""),
    "batch_departments": _quick("SELECT departamento, count(*) AS actas, CAST(sum(total_votos) AS BIGINT) AS votos FROM good GROUP BY 1"),
    "ingest_summary": _submitted("""
SELECT CASE WHEN motivo IS NULL THEN 'exitoso' WHEN motivo IN ('Acta no encontrada', 'El acta ya fue transcrita') THEN 'omitido'
            ELSE 'error' END AS resultado, count(*) AS filas FROM rul GROUP BY 1"""),
    # first wins
    "sms_duplicates": _with("SELECT seq, sha256(mensaje_raw) AS hash_mensaje, copia <> 1 AS es_primero FROM txt", _QUICK, _MESSAGES, _MESSAGE_TEXT),
    "append_sheets": _quick("""
SELECT 2 * a.k + CASE WHEN a.k % 42 = 0 AND (b.fecha_recepcion, b.k) < (a.fecha_recepcion, a.k) THEN 1 ELSE 0 END AS seq, a.acta_id
FROM sh a LEFT JOIN sh b ON a.k % 42 = 0 AND b.k = a.k - 1
LEFT JOIN sh c ON c.k = a.k + 1 AND c.k % 42 = 0 AND c.k % 4 <> 0 AND (c.fecha_recepcion, c.k) < (a.fecha_recepcion, a.k)
WHERE a.k % 4 <> 0 AND c.k IS NULL"""),
    "first_sheet_wins": _quick("SELECT k * 2 AS seq, acta_id, tipo_entrada FROM sh"),
    "municipality_table": _base(f"""
SELECT "Departamento", "Municipio", "P1", "P2", "P3", "P4", "VotosValidos", "VotosBlancos", "VotosNulos",
       {_TURNOUT} AS "Participacion", {_PARTY.format(_WINNER)} AS "Ganador" FROM muni"""),
    "turnout_ranking": _base(f'SELECT "Departamento", {_TURNOUT} AS "Participacion" FROM dept'),
    "first_errors": _quick("SELECT acta_id, estado, errores FROM sh WHERE estado = 'ERROR' ORDER BY k LIMIT 10"),
    # reshaping
    "inconsistencies_all": _log("SELECT acta_id, tipo, descripcion, severidad, fuente, fecha FROM log"),
    "merge_observations": """
SELECT o_orderkey AS k, concat_ws(' | ', 'mancha', CASE WHEN o_orderkey % 2 = 0 THEN 'lapiz' END,
       CASE WHEN o_orderkey % 2 <> 0 THEN '[Python] lapiz' END, CASE WHEN o_orderkey % 3 = 0 THEN '[Python] arruga' END,
       CASE WHEN o_orderkey % 6 = 0 THEN '[Python] arruga' END) AS observaciones FROM orders""",
    "votes_long_by_department": _base(f"""
SELECT "Departamento", p AS "Partido", CASE p WHEN 'P1' THEN "P1" WHEN 'P2' THEN "P2" WHEN 'P3' THEN "P3" ELSE "P4" END AS "Votos",
       {_PARTY.format("p")} AS "PartidoLabel" FROM dept CROSS JOIN (VALUES ('P1'), ('P2'), ('P3'), ('P4')) x(p)"""),
    "comparison_table": _messages("""
SELECT categoria, CAST(oficial AS BIGINT) AS oficial, CAST(rapido AS BIGINT) AS rapido, CAST(oficial - rapido AS BIGINT) AS diferencia FROM (
  SELECT 'Votos Válidos' AS categoria, (SELECT sum("VotosValidos") FROM muni) AS oficial, (SELECT sum("VotosValidos") FROM smuni) AS rapido
  UNION ALL SELECT 'Votos Blancos', (SELECT sum("VotosBlancos") FROM muni), (SELECT sum("VotosBlancos") FROM smuni)
  UNION ALL SELECT 'Votos Nulos', (SELECT sum("VotosNulos") FROM muni), (SELECT sum("VotosNulos") FROM smuni)
  UNION ALL SELECT 'Partido 1 (MAS-IPSP)', (SELECT sum("P1") FROM muni), (SELECT sum("P1") FROM smuni)
  UNION ALL SELECT 'Partido 2 (CC)', (SELECT sum("P2") FROM muni), (SELECT sum("P2") FROM smuni)
  UNION ALL SELECT 'Partido 3 (FPV)', (SELECT sum("P3") FROM muni), (SELECT sum("P3") FROM smuni)
  UNION ALL SELECT 'Partido 4 (APB)', (SELECT sum("P4") FROM muni), (SELECT sum("P4") FROM smuni))"""),
    # messages
    "parse_sms": _messages("""
SELECT seq, acta_id AS sms_acta, departamento AS sms_dep, municipio AS sms_mun, CASE WHEN k % 47 <> 0 THEN recinto END AS sms_rec,
       CAST(nro_mesa AS VARCHAR) AS sms_mesa, val AS sms_val, nul AS sms_nul, votos_blancos AS sms_bla,
       CASE WHEN k % 30 = 0 THEN '0000' ELSE '4821' END AS sms_pin, n_errores FROM msg"""),
    "sms_candidates": _messages("""
SELECT seq, 'C' || i AS candidato_id, CASE i WHEN 1 THEN v1 WHEN 2 THEN P2 WHEN 3 THEN v3 ELSE P4 END AS votos
FROM msg CROSS JOIN (VALUES (1), (2), (3), (4)) x(i)"""),
    "sms_errors": _messages("""
SELECT seq, 1 AS parte, i - 1 AS orden, l[i] AS error
FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT seq, list_filter([m1, m2, m3], lambda x: x IS NOT NULL) AS l FROM msg))
UNION ALL SELECT seq, 2, 3, m4 FROM msg WHERE m4 IS NOT NULL"""),
    "sms_to_sheet": _messages("""
SELECT seq, acta_id, departamento, municipio, CASE WHEN k % 47 <> 0 THEN recinto ELSE '' END AS recinto,
       CAST(nro_mesa AS VARCHAR) AS mesa, val AS votos_validos, nul AS votos_nulos, votos_blancos, total AS total_votos FROM msg"""),
    "sms_hash": _with("SELECT seq, sha256(mensaje_raw) AS hash_mensaje FROM txt", _QUICK, _MESSAGES, _MESSAGE_TEXT),
    "sms_authorised": _messages("SELECT seq, NOT (k % 35 = 0 AND copia = 0) AS autorizado FROM msg"),
    "parse_sms_lenient": _messages("""
SELECT seq, departamento AS sms_dep, val AS sms_val, nul AS sms_nul,
       CAST(CASE WHEN m4 IS NULL THEN 4 ELSE 3 END AS INTEGER) AS n_candidatos,
       CAST(CASE WHEN m4 IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_huecos FROM msg"""),
    "parse_sms_star": _base("""
SELECT k, 'MESA-' || k AS sms_acta, votos_validos AS sms_val, votos_blancos AS sms_bla,
       CASE WHEN k % 9 = 0 THEN 0 ELSE votos_nulos END AS sms_nul, CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_candidatos,
       P1 + P2 + CASE WHEN k % 2 = 0 THEN P3 ELSE 0 END AS suma, CASE WHEN k % 9 = 0 THEN 'campo no numérico' ELSE '' END AS errores FROM tal"""),
    # readings
    "ocr_digit": """
SELECT o_orderkey AS k, substr('0123456789OolI|BSZGxb?', CAST(o_orderkey % 22 + 1 AS INTEGER), 1) AS c,
       CAST(CASE o_orderkey % 22 WHEN 10 THEN 0 WHEN 11 THEN 0 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 14 THEN 1 WHEN 15 THEN 8
            WHEN 16 THEN 5 WHEN 17 THEN 2 WHEN 18 THEN 6 WHEN 19 THEN 0 WHEN 20 THEN 0 WHEN 21 THEN 0
            ELSE o_orderkey % 22 END AS INTEGER) AS digito FROM orders""",
    "ocr_number": _base("""
SELECT k, CASE WHEN k % 11 = 0 THEN 0 ELSE votos_validos END AS numero,
       regexp_replace(CAST(votos_validos AS VARCHAR), '[015826]', '', 'g') AS digitos FROM tal"""),
    "repair_numeric": _base("""
SELECT k, votos_validos || CASE WHEN k % 11 = 0 THEN '?' ELSE '' END AS corregido, k % 11 = 0 AS sospechoso FROM tal"""),
    "parse_embedded_text": _files("""
SELECT seq, acta_id, f_codigo AS codigo_mesa, f_dep AS departamento, provincia, f_mun AS municipio, f_rec AS recinto, f_mesa AS mesa,
       f_val AS votos_validos, f_bla AS votos_blancos, f_nul AS votos_nulos, f_hab AS electores_habilitados, f_anf AS papeletas_anfora,
       f_sin AS papeletas_no_utilizadas, f_c1 AS c1, f_c2 AS c2, f_c3 AS c3, f_c4 AS c4 FROM fil WHERE pdf"""),
    "parse_ocr_text": _files("""
SELECT seq, acta_id, f_codigo AS codigo_mesa, f_dep AS departamento, provincia, f_mun AS municipio, f_rec AS recinto, f_mesa AS mesa,
       f_val AS votos_validos, f_bla AS votos_blancos, f_nul AS votos_nulos, f_hab AS electores_habilitados, f_anf AS papeletas_anfora,
       f_sin AS papeletas_no_utilizadas, f_c1 AS c1, f_c2 AS c2, f_c3 AS c3, f_c4 AS c4 FROM fil WHERE NOT pdf"""),
    "sheet_text_errors": _files("""
SELECT seq, CASE WHEN k % 37 = 0 THEN 'ANULADA' WHEN errores <> '' THEN 'ERROR' ELSE 'PROCESADA' END AS estado,
       CASE WHEN k % 37 = 0 THEN 'TEXTO_ANULADA' ELSE '' END AS motivo_estado, errores
FROM (SELECT seq, k, concat_ws(' | ', CASE WHEN k % 37 = 0 THEN 'Acta marcada como ANULADA' END,
        CASE WHEN f_c1 IS NULL THEN 'solo se encontraron 6 tripletes de votos (se necesitan mínimo 7)' END,
        CASE WHEN f_codigo = '' AND f_mesa = '' THEN 'no se pudo determinar ID del acta' END,
        CASE WHEN f_val > 0 AND f_c1 IS NOT NULL AND f_suma <> f_val
          THEN 'inconsistencia aritmética: suma_candidatos(' || f_suma || ') != votos_válidos(' || f_val || ')' END) AS errores FROM fil)"""),
    "decode_triplets": _files("""
SELECT seq, CAST(CASE WHEN sin_tripletes THEN 6 ELSE 10 END AS INTEGER) AS n, f_c1 AS t_c1, f_c2 AS t_c2, f_c3 AS t_c3, f_c4 AS t_c4,
       CASE WHEN NOT sin_tripletes THEN f_val END AS t_validos, CASE WHEN NOT sin_tripletes THEN f_bla END AS t_blancos,
       CASE WHEN NOT sin_tripletes THEN f_nul END AS t_nulos, f_hab AS electores_habilitados, f_anf AS papeletas_anfora,
       f_sin AS papeletas_no_utilizadas FROM fil WHERE pdf"""),
    "department_from_text": _files("""
SELECT seq, CASE WHEN departamento = 'Exterior' THEN '' ELSE departamento END AS departamento FROM fil"""),
    "department_in_documents": """
SELECT doc_id, CASE WHEN contains(u, 'CHUQUISACA') THEN 'Chuquisaca' WHEN contains(u, 'LA PAZ') THEN 'La Paz'
       WHEN contains(u, 'COCHABAMBA') THEN 'Cochabamba' WHEN contains(u, 'ORURO') THEN 'Oruro' WHEN contains(u, 'POTOSÍ') THEN 'Potosí'
       WHEN contains(u, 'TARIJA') THEN 'Tarija' WHEN contains(u, 'SANTA CRUZ') THEN 'Santa Cruz' WHEN contains(u, 'BENI') THEN 'Beni'
       WHEN contains(u, 'PANDO') THEN 'Pando' ELSE '' END AS departamento
FROM (SELECT doc_id, upper(text) AS u FROM documents)""",
    "votes_by_name": _files("""
SELECT seq, CASE WHEN sin_tripletes THEN f_c1 ELSE 0 END AS c1, CASE WHEN sin_tripletes THEN f_c2 ELSE 0 END AS c2,
       CASE WHEN sin_tripletes THEN f_c3 ELSE 0 END AS c3, CASE WHEN sin_tripletes THEN f_c4 ELSE 0 END AS c4
FROM fil WHERE NOT pdf"""),
    "sheet_identity": _files("SELECT seq, file_name, f_codigo AS codigo_mesa, f_mesa AS mesa, acta_id FROM fil"),
    "annulled_text": _files("SELECT seq, k % 37 = 0 AS anulada, k % 37 = 0 AS anulada_estricta FROM fil"),
    "annulled_documents": """
SELECT doc_id, contains(upper(text), 'ANULAD') OR contains(upper(text), 'NULA') OR contains(upper(text), 'NULO') AS anulada FROM documents""",
    "choose_ocr_pass": """
SELECT doc_id, CAST(strlen(text) + CASE WHEN doc_id % 2 = 0 THEN 21 ELSE 0 END AS BIGINT) AS bytes FROM documents""",
    "text_is_usable": """
SELECT doc_id, strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 20 AND regexp_matches(text, '[0-9]') AS usable FROM documents""",
    "join_first": _quick("""
SELECT acta_id, CASE WHEN n_errores <= 2 THEN array_to_string(l, '; ')
       ELSE array_to_string(l[1:2], '; ') || ' (y ' || (n_errores - 2) || ' más)' END AS resumen
FROM (SELECT acta_id, n_errores, list_filter([e1, e2, e3, e4, e5, e6, e7, e8, e9, e10], lambda x: x IS NOT NULL) AS l FROM sh)"""),
    "notification_outbox": _messages("""
SELECT seq, telefono AS destinatario,
  CASE WHEN etapa = 'FORMATO' THEN '❌ Sistema RRV Bolivia: Error en formato de SMS. ' || errores_pc
         || '. Formato: ACTA:MESA-ID|DEP:Dept|MUN:Mun|MESA:N|VAL:N|NUL:N|BLA:N|C1:N|C2:N|PIN:1234'
       WHEN val > 0 AND v1 + P2 + v3 + P4 <> val
         THEN '⚠️ Sistema RRV Bolivia: Acta ' || acta_id || ' recibida con errores de validación. Será revisada.'
       ELSE '✅ Sistema RRV Bolivia: Acta ' || acta_id || ' recibida y procesada correctamente.' END AS mensaje,
  CASE WHEN etapa <> 'FORMATO' THEN '' WHEN n_errores <= 2 THEN errores_pc
       ELSE array_to_string(list_filter([m1, m2, m3, m4], lambda x: x IS NOT NULL)[1:2], '; ') || ' (y ' || (n_errores - 2) || ' más)' END AS resumen
FROM jud WHERE etapa = 'FORMATO' OR estado_sms = 'PROCESADO'"""),
    # rules
    "validate_sheets": _quick("SELECT acta_id, n_errores, errores FROM sh"),
    "decide_state": _quick("SELECT acta_id, estado, motivo_estado FROM sh"),
    "inconsistencies_arithmetic": _quick(f"SELECT acta_id, tipo, descripcion, severidad FROM ({_ARITHMETIC})"),
    "inconsistencies_contradictory": _quick(f"SELECT acta_id, tipo, descripcion, severidad FROM ({_CONTRADICTORY})"),
    "inconsistencies_missing_times": _quick(f"SELECT acta_id, tipo, descripcion, severidad FROM ({_MISSING})"),
    "inconsistencies_duplicates": _quick("""
SELECT acta_id, 'DUPLICADO_DATOS_DIFERENTES' AS tipo, 'Acta recibida con anterioridad y datos no coinciden: ' || concat_ws('; ',
         CASE WHEN k % 2 = 0 THEN 'votos_validos: anterior=' || votos_validos || ', nuevo=' || (votos_validos + 3) END,
         CASE WHEN k % 5 = 0 THEN 'departamento: anterior=' || departamento || ', nuevo=Tarija' END) AS descripcion, 'CRITICA' AS severidad
FROM sh WHERE k % 21 = 0 AND (k % 2 = 0 OR k % 5 = 0)"""),
    "official_valid": _submitted("SELECT fila, codigo_acta, votos_validos FROM rul WHERE motivo IS NULL"),
    "official_rejects_in_store": _submitted("""
SELECT fila, codigo_acta, m AS motivo FROM (
  SELECT *, CASE WHEN (motivo IS NULL OR motivo = 'El acta ya fue transcrita')
      AND codigo_acta IN (SELECT codigo_acta FROM done) THEN 'El acta ya fue transcrita' ELSE motivo END AS m
  FROM rul) WHERE m IS NOT NULL"""),
    "official_rejects": _submitted("SELECT fila, codigo_acta, motivo FROM rul WHERE motivo IS NOT NULL"),
    "prevalidate_rows": _submitted("""
SELECT fila, CASE
    WHEN papeletas_no_utilizadas < 0 THEN 'campo "PapeltasNoUtilizadas" es negativo (' || papeletas_no_utilizadas || ')'
    WHEN P1 + P2 + P3 + P4 <> votos_validos THEN 'P1+P2+P3+P4 (' || (P1 + P2 + P3 + P4) || ') ≠ VotosValidos (' || votos_validos || ')'
    WHEN votos_validos + votos_blancos + votos_nulos <> papeletas_anfora
      THEN 'VotosValidos+Blancos+Nulos (' || (votos_validos + votos_blancos + votos_nulos) || ') ≠ PapeletasAnfora (' || papeletas_anfora || ')'
    END AS motivo FROM sub"""),
    "visual_flags": _images("SELECT * EXCLUDE (k) FROM flg"),
    "preprocess_flags": _images("SELECT * EXCLUDE (k) FROM pre"),
    "merge_visual_flags": _images("""
SELECT acta_id, m AS mancha_detectada, pct AS porcentaje_mancha, s AS numeros_sobreescritos, r AS flag_revision_manual, u AS pipeline_python_usado,
  CAST(CASE WHEN u THEN pm::INT + s::INT + c::INT + h::INT ELSE 0 END
    + lapiz_detectado::INT + (tachadura_detectada OR s)::INT + texto_anulada_visual::INT + rotura_detectada::INT
    + (NOT firmas_suficientes)::INT + m::INT + arrugas_detectadas::INT + c::INT + h::INT AS INTEGER) AS n_observaciones
FROM (SELECT f.*, f.k % 4 <> 0 AS u, f.k % 4 <> 0 AND p.mancha_detectada AS pm, f.k % 4 <> 0 AND p.numeros_sobreescritos AS s,
             f.k % 4 <> 0 AND p.confusion_alfanumerica AS c, f.k % 4 <> 0 AND p.huellas_zona_numeros AS h,
             f.k % 4 <> 0 AND p.flag_revision_manual AS r, f.mancha_detectada OR (f.k % 4 <> 0 AND p.mancha_detectada) AS m,
             CASE WHEN NOT f.mancha_detectada AND f.k % 4 <> 0 AND p.mancha_detectada THEN p.porcentaje_mancha ELSE f.porcentaje_mancha END AS pct
      FROM flg f JOIN pre p ON f.k = p.k)"""),
    "has_visual_flags": _images("""
SELECT f.acta_id, lapiz_detectado OR tachadura_detectada OR numeros_sobreescritos OR confusion_alfanumerica OR huellas_zona_numeros
       OR rotura_detectada OR f.mancha_detectada OR p.mancha_detectada OR NOT firmas_suficientes AS con_alertas
FROM flg f JOIN pre p ON f.k = p.k"""),
    # SQL over the registered views
    "sql_official_by_municipality": _base("SELECT * FROM muni"),
    "sql_top_precincts": _base("""
SELECT recinto, CAST(sum(P2) AS BIGINT) AS votos, 'P2' AS candidato FROM tr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"""),
    "sql_high_abstention": _base("""
SELECT * FROM (
  SELECT departamento, recinto, nro_mesa, codigo_acta, votantes_habilitados, papeletas_anfora AS votos_emitidos,
         CASE WHEN votantes_habilitados > 0 THEN (votantes_habilitados - papeletas_anfora) / votantes_habilitados * 100
              ELSE 0.0 END AS abstencion_pct FROM tr) WHERE abstencion_pct > 15.0 AND departamento = 'La Paz'"""),
    "sql_votes_below": _base(f"""
SELECT municipio AS geo, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS total_votos FROM tr WHERE departamento = 'La Paz' GROUP BY 1
UNION ALL
SELECT provincia, {_SUMS}, CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) FROM tr
WHERE departamento = 'La Paz' AND provincia = 'BUILDING' GROUP BY 1"""),
    "sql_sheet_history": _with("""
SELECT 'evento' AS seccion, event_type AS detalle, ts::TIMESTAMP AS fecha FROM events WHERE user_id = 7
UNION ALL SELECT 'inconsistencia', tipo, fecha FROM log WHERE k = 7
UNION ALL SELECT 'estado_actual', estado, fecha_recepcion FROM sh WHERE k = 7""", _QUICK, _LOG),
    # events
    "sms_events": _messages("""
SELECT seq, CAST(paso AS INTEGER) AS paso, acta_id, tipo_evento, llegada AS fecha FROM (
  SELECT seq, llegada, 1 AS paso, 'PENDIENTE' AS acta_id, 'SMS_RECIBIDO' AS tipo_evento FROM jud
  UNION ALL SELECT seq, llegada, 2, 'RECHAZADO', 'SMS_TELEFONO_NO_AUTORIZADO' FROM jud WHERE etapa = 'TELEFONO'
  UNION ALL SELECT seq, llegada, 2, CASE WHEN k % 35 = 0 OR n_errores > 0 THEN '' ELSE acta_id END, 'SMS_DUPLICADO' FROM jud WHERE etapa = 'HASH'
  UNION ALL SELECT seq, llegada, 2, acta_id, 'SMS_PIN_INVALIDO' FROM jud WHERE etapa = 'PIN'
  UNION ALL SELECT seq, llegada, 3, acta_id, 'INCONSISTENCIAS_DETECTADAS' FROM jud WHERE seq IN (SELECT seq FROM smi)
  UNION ALL SELECT seq, llegada, 4, acta_id, CASE estado_sms WHEN 'PROCESADO' THEN 'ACTA_GUARDADA' ELSE 'DUPLICADO_DETECTADO' END
            FROM jud WHERE etapa = 'ACTA')"""),
    "sms_register": _messages("""
SELECT seq, telefono, CASE WHEN etapa IN ('TELEFONO', 'FORMATO') THEN '' ELSE acta_id END AS acta_id, estado_sms AS estado,
       CASE WHEN etapa = 'TELEFONO' THEN 'Teléfono no autorizado' WHEN etapa = 'FORMATO' THEN concat_ws(' | ', m1, m2, m3)
            WHEN etapa = 'PIN' THEN 'PIN de verificación inválido' WHEN estado_sms = 'DUPLICADO' THEN 'Acta ' || acta_id || ' ya existe en el sistema'
            ELSE '' END AS errores,
       CASE WHEN etapa = 'FORMATO' AND m4 IS NOT NULL THEN '3-3' ELSE '' END AS huecos
FROM jud WHERE copia <> 1"""),
    "sms_inconsistencies": _messages("SELECT acta_id, tipo, descripcion, severidad FROM smi"),
    "upload_outcomes": _files("SELECT seq, acta_id, resultado, estado FROM up"),
    "upload_outcomes_in_store": _with("""
SELECT up.seq, up.acta_id, CASE WHEN s.k IS NOT NULL THEN 'DUPLICADO_ACTA' ELSE resultado END AS resultado,
       CASE WHEN s.k IS NOT NULL THEN sha256(CAST(s.codigo_acta AS VARCHAR))
            WHEN resultado <> 'GUARDADA' THEN sha256(t.texto) END AS hash_previo
FROM up LEFT JOIN sh s ON s.acta_id = up.acta_id AND s.k % 5 = 0
LEFT JOIN kept p ON p.acta_id = up.acta_id LEFT JOIN ftx t ON t.seq = p.pk * 4 + p.pcopia""", _QUICK, _FILES, _FILE_TEXT),
    "upload_states_by_image": _with("""
SELECT seq, acta_id, resultado, CASE WHEN motivo <> '' THEN 'ANULADA' WHEN malo THEN 'ERROR' WHEN m THEN 'OBSERVADA' ELSE 'PROCESADA' END AS estado,
  CASE WHEN motivo = '' AND m AND NOT malo THEN 'MANCHA_SOBRE_DATOS' ELSE motivo END AS motivo_estado
FROM (
  SELECT up.seq, up.acta_id, resultado, f.mancha_detectada OR (up.k % 4 <> 0 AND p.mancha_detectada) AS m,
    f_mun = '' OR f_dep = '' OR f_mesa = '' OR f_c1 IS NULL OR (f_val > 0 AND f_suma <> f_val) AS malo,
    CASE WHEN up.k % 37 = 0 THEN 'TEXTO_ANULADA' WHEN texto_anulada_visual THEN 'TEXTO_ANULADA_VISUAL'
         WHEN lapiz_detectado THEN 'USO_DE_LAPIZ' WHEN tachadura_detectada THEN 'TACHADURA_NUMEROS'
         WHEN rotura_detectada THEN 'ROTURA_CRITICA' WHEN NOT firmas_suficientes THEN 'FALTA_FIRMAS_HUELLAS'
         WHEN f_hab > 0 AND f_total > f_hab THEN 'VOTOS_MAYOR_QUE_VOTANTES' ELSE '' END AS motivo
  FROM up JOIN flg f ON f.k = up.k JOIN pre p ON p.k = up.k)""", _QUICK, _FILES, _IMAGES),
    "upload_events": _files("""
SELECT seq, CAST(paso AS INTEGER) AS paso, acta_id, tipo_evento, llegada AS fecha FROM (
  SELECT seq, llegada, 1 AS paso, 'PENDIENTE' AS acta_id, 'ACTA_RECIBIDA' AS tipo_evento FROM up
  UNION ALL SELECT seq, llegada, 2, acta_id, CASE resultado WHEN 'DUPLICADO_HASH' THEN 'DUPLICADO_DETECTADO' ELSE 'OCR_PROCESADO' END FROM up
  UNION ALL SELECT seq, llegada, 3, acta_id, CASE WHEN con_errores THEN 'VALIDACION_ERROR' ELSE 'VALIDACION_OK' END FROM up WHERE resultado <> 'DUPLICADO_HASH'
  UNION ALL SELECT seq, llegada, 4, acta_id, 'INCONSISTENCIAS_DETECTADAS' FROM up WHERE resultado <> 'DUPLICADO_HASH' AND con_inc
  UNION ALL SELECT seq, llegada, 5, acta_id, CASE resultado WHEN 'GUARDADA' THEN 'ACTA_GUARDADA' ELSE 'DUPLICADO_DETECTADO' END
            FROM up WHERE resultado <> 'DUPLICADO_HASH')"""),
    # streaming shapes
    "latest_state": _events("""
SELECT acta_id, tipo_evento AS ultimo_evento, fecha, n AS eventos FROM (
  SELECT *, row_number() OVER (PARTITION BY acta_id ORDER BY fecha DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY acta_id) AS n FROM evt)
WHERE rn = 1"""),
    "arrivals_per_minute": _quick("""
SELECT date_trunc('minute', fecha_recepcion) AS inicio, date_trunc('minute', fecha_recepcion) + INTERVAL 1 MINUTE AS fin,
       count(*) AS recibidas FROM sh GROUP BY 1, 2"""),
    # extensions
    "q09_vote_mix": _base("""
SELECT departamento, CAST(sum(votos_nulos) AS BIGINT) AS votos_nulos, CAST(sum(votos_blancos) AS BIGINT) AS votos_blancos,
       CAST(sum(P1 + P2 + P3 + P4) AS BIGINT) AS por_candidatos, CAST(sum(votos_validos) AS BIGINT) AS votos_validos,
       CAST(sum(votos_validos - votos_blancos) AS BIGINT) AS validos_menos_blancos FROM tr GROUP BY 1"""),
    "q10_active_precincts": _quick("SELECT codigo_recinto, recinto, departamento, count(*) AS actas FROM sh GROUP BY 1, 2, 3"),
    "q13_annulled_share": _with(f"""
SELECT departamento, coalesce(qa, 0) AS anuladas_trep, coalesce(oa, 0) AS anuladas_oficial,
       {_pct("coalesce(qa, 0)", "coalesce(qn, 0)")} AS pct_trep, {_pct("coalesce(oa, 0)", "coalesce(on_, 0)")} AS pct_oficial
FROM (SELECT departamento, count(*) AS qn, count(*) FILTER (estado = 'ANULADA') AS qa FROM sh GROUP BY 1)
FULL JOIN (SELECT departamento, count(*) AS on_, count(*) FILTER (motivo IS NOT NULL) AS oa
           FROM rul JOIN places USING (codigo_recinto) GROUP BY 1) USING (departamento)""", _SUBMITTED, _QUICK),
    "q14_mean_delay": _quick("""
SELECT departamento, min(fecha_recepcion) AS primera_acta, max(fecha_recepcion) AS ultima_acta,
       CASE WHEN count(s) > 0 THEN CAST(sum(s) AS BIGINT) / count(s) / 60 ELSE 0.0 END AS minutos_promedio
FROM (SELECT departamento, fecha_recepcion, CASE WHEN k * 37 % 86400 >= 57600 THEN k * 37 % 86400 - 57600 END AS s FROM sh) GROUP BY 1"""),
    "q15_reliability": _with(f"""
SELECT fuente, buenas, actas, {_pct("buenas", "actas")} AS pct_confianza FROM (
  SELECT 'TREP' AS fuente, count(*) FILTER (estado = 'PROCESADA' AND k % 25 <> 0 AND k % 90 <> 0 AND k % 60 <> 0) AS buenas, count(*) AS actas FROM sh
  UNION ALL SELECT 'OFICIAL', count(*) FILTER (motivo IS NULL), count(*) FROM rul)""", _SUBMITTED, _QUICK),
    "q17_sheet_diff": _quick("""
SELECT acta_id, CAST(CASE WHEN k % 25 = 0 THEN -1 ELSE 0 END AS BIGINT) AS dif_p1, CAST(0 AS BIGINT) AS dif_p2, CAST(0 AS BIGINT) AS dif_p3,
       CAST(0 AS BIGINT) AS dif_p4, CAST(0 AS BIGINT) AS dif_votos_validos, CAST(0 AS BIGINT) AS dif_votos_blancos,
       CAST(0 AS BIGINT) AS dif_votos_nulos, ref_anfora - anfora_reportada AS dif_papeletas_anfora,
       ref_hab - electores_habilitados AS dif_votantes_habilitados
FROM sh WHERE k % 25 = 0 OR k % 90 = 0 OR k % 60 = 0"""),
    "q18_file_volume": _with("""
SELECT departamento, count(*) AS archivos, CAST(sum(strlen(texto)) AS BIGINT) AS bytes,
       CAST(sum(strlen(texto)) AS BIGINT) / 1048576 AS megabytes FROM ftx GROUP BY 1""", _QUICK, _FILES, _FILE_TEXT),
    "processing_rate": _quick(f"""
SELECT date_trunc('day', fecha_recepcion)::TIMESTAMP AS inicio, count(*) AS recibidas, count(*) FILTER (estado = 'PROCESADA') AS procesadas,
       count(*) / 24 AS por_hora, {_pct("count(*) FILTER (estado = 'PROCESADA')", "count(*)")} AS pct_procesadas FROM sh GROUP BY 1"""),
    "turnout_outliers": _base("""
SELECT departamento, codigo_acta, centesimas, z FROM (
  SELECT departamento, codigo_acta, centesimas, CASE WHEN var > 0 THEN round((centesimas - s / n) / sqrt(var), 4) END AS z
  FROM (SELECT departamento, codigo_acta, papeletas_anfora * 10000 // votantes_habilitados AS centesimas FROM tr WHERE votantes_habilitados > 0) b
  JOIN (SELECT departamento, n, s, CASE WHEN n > 1 THEN (q - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / (n - 1) END AS var
        FROM (SELECT departamento, count(*) AS n, CAST(sum(c) AS BIGINT) AS s, CAST(sum(CAST(c * c AS DECIMAL(38, 0))) AS DOUBLE) AS q
              FROM (SELECT departamento, papeletas_anfora * 10000 // votantes_habilitados AS c FROM tr WHERE votantes_habilitados > 0) GROUP BY 1)) st
  USING (departamento)) WHERE abs(z) > 2.0"""),
    # indicators
    "state_as_of": _events("""
SELECT acta_id, momento, tipo_evento AS ultimo_evento, fecha, n AS eventos FROM (
  SELECT evt.*, momento, row_number() OVER (PARTITION BY acta_id, momento ORDER BY fecha DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY acta_id, momento) AS n
  FROM evt JOIN (VALUES (TIMESTAMP '2024-01-05 00:00:00'), (TIMESTAMP '2024-01-15 12:00:00'), (TIMESTAMP '2024-01-31 00:00:00')) v(momento)
    ON fecha <= momento) WHERE rn = 1"""),
    "turnout_outliers_robust": _base("""
SELECT * FROM (
  SELECT departamento, codigo_acta, centesimas, mediana, mad, CASE WHEN mad > 0 THEN round(0.6745::DOUBLE * (centesimas - mediana) / mad, 4) END AS puntaje
  FROM (SELECT departamento, codigo_acta, papeletas_anfora * 10000 // votantes_habilitados AS centesimas FROM tr WHERE votantes_habilitados > 0) b
  JOIN (SELECT departamento, any_value(m) AS mediana, quantile_cont(abs(c - m), 0.5) AS mad FROM (
          SELECT departamento, c, median(c) OVER (PARTITION BY departamento) AS m
          FROM (SELECT departamento, papeletas_anfora * 10000 // votantes_habilitados AS c FROM tr WHERE votantes_habilitados > 0))
        GROUP BY 1) st USING (departamento)) WHERE abs(puntaje) > 2.0"""),
    "digit_test": _base("""
SELECT codigo_recinto, cifras, chi2, chi2 > 21.666 AS sospechoso FROM (
  SELECT codigo_recinto, CAST(sum(o) AS BIGINT) AS cifras, round(CAST(10 * sum(o * o) - sum(o) * sum(o) AS DOUBLE) / sum(o), 6) AS chi2
  FROM (SELECT codigo_recinto, v % 10 AS d, count(*) AS o
        FROM (SELECT codigo_recinto, unnest([P1, P2, P3, P4]) AS v FROM tr) WHERE v >= 10 GROUP BY 1, 2) GROUP BY 1)
WHERE cifras >= 10"""),
    "latency_by_hour": _quick("""
SELECT date_trunc('hour', fecha_recepcion) AS inicio, count(*) AS actas, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95
FROM (SELECT fecha_recepcion, k * 37 % 86400 - 57600 AS s FROM sh) WHERE s >= 0 GROUP BY 1"""),
    "active_places_by_hour": _quick("""
SELECT date_trunc('hour', fecha_recepcion) AS inicio, count(DISTINCT codigo_recinto) AS recintos FROM sh GROUP BY 1"""),
}
