"""Column layouts of the tables the engine reads and writes."""

from pyspark.sql import types as T


def _struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, I, L, D, B, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

CANDIDATES = T.ArrayType(_struct(candidato_id=S, votos=L))

VISUAL = _struct(
    lapiz_detectado=B,
    intensidad_promedio=D,
    ratio_contraste=D,
    mancha_detectada=B,
    porcentaje_mancha=D,
    huellas_detectadas=I,
    firmas_suficientes=B,
    corrector_detectado=B,
    tachadura_detectada=B,
    rotura_detectada=B,
    texto_anulada_visual=B,
    numeros_sobreescritos=B,
    celdas_sobreescritas=T.ArrayType(S),
    confusion_alfanumerica=B,
    campos_sospechosos=T.ArrayType(S),
    huellas_zona_numeros=B,
    arrugas_detectadas=B,
    flag_revision_manual=B,
    pipeline_python_usado=B,
    observaciones=T.ArrayType(S),
)

SHEET = _struct(
    acta_id=S,
    codigo_mesa=S,
    departamento=S,
    provincia=S,
    municipio=S,
    recinto=S,
    mesa=S,
    candidatos=CANDIDATES,
    votos_validos=L,
    votos_nulos=L,
    votos_blancos=L,
    total_votos=L,
    electores_habilitados=L,
    papeletas_anfora=L,
    papeletas_no_utilizadas=L,
    estado=S,
    motivo_estado=S,
    fuente=S,
    tipo_entrada=S,
    hash_origen=S,
    errores=T.ArrayType(S),
    validacion_visual=VISUAL,
    fecha_recepcion=TS,
)

SMS_MESSAGE = _struct(telefono=S, mensaje_raw=S, fecha_recepcion=TS, seq=L)

SMS_REGISTER = _struct(
    telefono=S,
    mensaje_raw=S,
    hash_mensaje=S,
    acta_id=S,
    estado=S,
    errores=T.ArrayType(S),
    fecha_recepcion=TS,
)

EVENT = _struct(
    acta_id=S,
    tipo_evento=S,
    descripcion=S,
    metadata=T.MapType(S, S),
    fecha=TS,
)

INCONSISTENCY = _struct(
    acta_id=S,
    tipo=S,
    descripcion=S,
    severidad=S,
    metadata=T.MapType(S, S),
    fuente=S,
    fecha=TS,
)

TERRITORY = _struct(CodigoTerritorial=I, Departamento=S, Municipio=S, Provincia=S)

PRECINCT = _struct(
    recintoCode=S,
    CodigoTerritorial=I,
    CodigoRecinto=L,
    RecintoNombre=S,
    RecintoDireccion=S,
    NumMesas=I,
)

# Transcription files arrive with every value as text; two header spellings are in use.
TRANSCRIPTION_ALIASES = {
    "PapeletasEnAnfora": "PapeletasAnfora",
    "PapeletasNoUtilizadas": "PapeltasNoUtilizadas",
}
TRANSCRIPTION_COUNTS = {
    "p1": "P1",
    "p2": "P2",
    "p3": "P3",
    "p4": "P4",
    "votos_validos": "VotosValidos",
    "votos_blancos": "VotosBlancos",
    "votos_nulos": "VotosNulos",
    "papeletas_anfora": "PapeletasAnfora",
    "papeletas_no_utilizadas": "PapeltasNoUtilizadas",
    "apertura_minutos": "AperturaMinutos",
    "cierre_minutos": "CierreMinutos",
}
