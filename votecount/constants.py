"""Names, word lists, message texts and thresholds the results depend on.

Everything in this module is a fixed value: results only agree with the counts
they are compared to when these strings and numbers are exactly these.
"""

# --- sheet states and reasons (fixed values) ---------------------------------
PROCESADA = "PROCESADA"
ERROR = "ERROR"
ANULADA = "ANULADA"
OBSERVADA = "OBSERVADA"
SHEET_STATES = (PROCESADA, ERROR, ANULADA, OBSERVADA)

TEXTO_ANULADA = "TEXTO_ANULADA"
TEXTO_ANULADA_VISUAL = "TEXTO_ANULADA_VISUAL"
USO_DE_LAPIZ = "USO_DE_LAPIZ"
USO_DE_CORRECTOR = "USO_DE_CORRECTOR"
TACHADURA_NUMEROS = "TACHADURA_NUMEROS"
FALTA_FIRMAS_HUELLAS = "FALTA_FIRMAS_HUELLAS"
ROTURA_CRITICA = "ROTURA_CRITICA"
VOTOS_MAYOR_QUE_VOTANTES = "VOTOS_MAYOR_QUE_VOTANTES"

MANCHA_SOBRE_DATOS = "MANCHA_SOBRE_DATOS"

# --- channels (fixed values) --------------------------------------------------
RRV = "RRV"
IMAGEN = "IMAGEN"
PDF = "PDF"
SMS = "SMS"

# --- event kinds (fixed values) -----------------------------------------------
ACTA_RECIBIDA = "ACTA_RECIBIDA"
OCR_PROCESADO = "OCR_PROCESADO"
VALIDACION_OK = "VALIDACION_OK"
VALIDACION_ERROR = "VALIDACION_ERROR"
ACTA_GUARDADA = "ACTA_GUARDADA"
DUPLICADO_DETECTADO = "DUPLICADO_DETECTADO"
SMS_RECIBIDO = "SMS_RECIBIDO"
SMS_PIN_INVALIDO = "SMS_PIN_INVALIDO"
SMS_TELEFONO_NO_AUTORIZADO = "SMS_TELEFONO_NO_AUTORIZADO"
SMS_DUPLICADO = "SMS_DUPLICADO"
INCONSISTENCIAS_DETECTADAS = "INCONSISTENCIAS_DETECTADAS"

# --- message register states (fixed values) -----------------------------------
SMS_PROCESADO = "PROCESADO"
SMS_ERROR = "ERROR"
SMS_DUPLICADO_ESTADO = "DUPLICADO"
SMS_RECHAZADO = "RECHAZADO"

# --- inconsistency kinds and severities (fixed values) ------------------------
INCONSISTENCIA_ARITMETICA = "INCONSISTENCIA_ARITMETICA"
DATOS_CONTRADICTORIOS = "DATOS_CONTRADICTORIOS"
FALTA_APERTURA_CIERRE = "FALTA_APERTURA_CIERRE"
DUPLICADO_DATOS_DIFERENTES = "DUPLICADO_DATOS_DIFERENTES"
CRITICA = "CRITICA"
ALTA = "ALTA"
MEDIA = "MEDIA"

# --- official row rejections (fixed values) -----------------------------------
RECHAZO_NO_ENCONTRADA = "Acta no encontrada"
RECHAZO_SUMA_PARTIDOS = "La suma de votos por partido no coincide con los votos válidos"
RECHAZO_ANFORA = "Los votos válidos, blancos y nulos no coinciden con las papeletas en ánfora"
RECHAZO_HABILITADOS = (
    "Las papeletas en ánfora más las no utilizadas no coinciden con los votantes habilitados"
)
RECHAZO_YA_TRANSCRITA = "El acta ya fue transcrita"

# --- parties and candidates (fixed values) ------------------------------------
PARTY_COLUMNS = ("P1", "P2", "P3", "P4")
DASHBOARD_PARTY_NAMES = {
    "P1": "Partido 1 (MAS-IPSP)",
    "P2": "Partido 2 (CC)",
    "P3": "Partido 3 (FPV)",
    "P4": "Partido 4 (APB)",
}
CANDIDATE_NAMES = {
    "P1": "Daenerys Targaryen",
    "P2": "Sansa Stark",
    "P3": "Robert Baratheon",
    "P4": "Tyrion Lannister",
}

# --- surnames and the misreadings accepted for them (fixed values) ------------
SURNAME_SPELLINGS = {
    "C1": ("targaryen", "targarven", "targaryem", "tarqaryen", "targarycn"),
    "C2": ("stark", "starh", "stork"),
    "C3": ("baratheon", "barathcon", "baratheom", "barathean"),
    "C4": ("lannister", "lamnister", "lannisler", "lamister", "lanmister"),
}

# --- territory (fixed values) -------------------------------------------------
DEPARTMENTS = (
    "Chuquisaca",
    "La Paz",
    "Cochabamba",
    "Oruro",
    "Potosí",
    "Tarija",
    "Santa Cruz",
    "Beni",
    "Pando",
)
DEPARTMENT_CENTROIDS = {
    "Beni": (-14.8333, -64.9),
    "Chuquisaca": (-19.0333, -65.2627),
    "Cochabamba": (-17.3936, -66.1570),
    "La Paz": (-16.4897, -68.1193),
    "Oruro": (-17.9833, -67.1333),
    "Pando": (-11.0200, -68.7500),
    "Potosí": (-19.5833, -65.7500),
    "Santa Cruz": (-17.7833, -63.1822),
    "Tarija": (-21.5333, -64.7333),
}

# --- sheet text (fixed values) ------------------------------------------------
EMBEDDED_MARKER = "--- FUENTE: TEXTO_EMBEBIDO ---"
FILE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".pdf", ".bmp", ".tiff")

# Look-alike characters and the digit each one stands for (fixed values).
LOOKALIKES_DIGIT = {
    "O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "B": "8", "S": "5", "Z": "2", "G": "6",
}
LOOKALIKES_NUMBER = {
    "O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2", "G": "6",
}
LOOKALIKES_FIELD = {
    "O": "0", "o": "0", "Q": "0",
    "l": "1", "I": "1", "|": "1", "i": "1",
    "Z": "2", "z": "2",
    "E": "3",
    "A": "4",
    "S": "5", "s": "5",
    "G": "6", "b": "6",
    "T": "7",
    "B": "8",
    "g": "9", "q": "9",
}
# Letters that stand for no digit (fixed value); look-alikes among them count as look-alikes.
SUSPICIOUS_LETTERS = "CDEFHJKLMNPRUVWXYacdfehjkmnprstuvwxy"

# --- thresholds of the visual rules (fixed values) ----------------------------
PENCIL_GRAY = (0.4, 0.9)
CENTER_BLACK_PCT = 15.0
CELL_DENSITY = 0.45
STAIN_PCT = 3.0
CORNER_DARK_PCT = 20.0
MARGIN_SHADOW = 0.25
BLANK_BLOCKS = 0.60
PRINT_PIXELS = 500
MAX_PRINTS = 12
MIN_PRINTS = 3
PRE_STAIN_PCT = 1.5
PRE_CELL_DENSITY = 0.38
PRE_CELL_BRANCHES = 6
PRE_PRINT_RATIO = 0.04

# --- defaults of the query bank (fixed values) --------------------------------
ABSTENTION_THRESHOLD = 20.0
TOP_PRECINCTS = 5
LATEST_ROWS = 500
SMS_TEXT_LIMIT = 1600
