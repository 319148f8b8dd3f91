"""Decisions over per-image measurements: from numbers to visual flags."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.scalars import compact


def visual_flags(measures: DataFrame) -> DataFrame:
    """Flags of one image per row of measurements.

    ``programmatic`` rows carry a fill colour and are checked for pencil; the others are
    scans and are checked for black text and for cells full of ink.
    """
    gray = F.col("gray_fill")
    scan = ~F.col("programmatic")
    pencil = F.col("programmatic") & (gray > K.PENCIL_GRAY[0]) & (gray < K.PENCIL_GRAY[1])
    stain = F.col("stain_pct") > K.STAIN_PCT
    corner = F.col("corner_dark_pct") > K.CORNER_DARK_PCT
    prints = F.least(F.lit(K.MAX_PRINTS), F.floor(F.col("print_pixels") / K.PRINT_PIXELS))
    one_dec = lambda c: F.round(c * 10) / 10
    return measures.select(
        "acta_id",
        F.coalesce(pencil, F.lit(False)).alias("lapiz_detectado"),
        F.when(pencil, gray * 255).otherwise(0.0).alias("intensidad_promedio"),
        F.when(pencil, 1.0 - gray).otherwise(0.0).alias("ratio_contraste"),
        (stain | corner).alias("mancha_detectada"),
        F.when(~stain & corner, one_dec(F.col("corner_dark_pct")))
        .otherwise(one_dec(F.col("stain_pct")))
        .alias("porcentaje_mancha"),
        prints.cast("int").alias("huellas_detectadas"),
        (prints >= K.MIN_PRINTS).alias("firmas_suficientes"),
        F.lit(False).alias("corrector_detectado"),
        (scan & (F.col("max_cell_density") > K.CELL_DENSITY)).alias("tachadura_detectada"),
        (F.col("blank_block_ratio") > K.BLANK_BLOCKS).alias("rotura_detectada"),
        (scan & (F.col("center_black_pct") > K.CENTER_BLACK_PCT)).alias("texto_anulada_visual"),
        (F.col("margin_shadow_ratio") > K.MARGIN_SHADOW).alias("arrugas_detectadas"),
    )


def overwritten_cells(cells: DataFrame) -> DataFrame:
    """Cells with too much ink or too many branch points, per sheet.

    The grid is fixed (14 rows by 3 columns), so the label list of one sheet never holds
    more than 42 entries however many measurements a sheet has.
    """
    dense = (F.col("density") > K.PRE_CELL_DENSITY) | (F.col("branches") >= K.PRE_CELL_BRANCHES)
    marked = cells.where(dense & F.col("fila").between(1, 14) & F.col("columna").between(1, 3))
    return marked.groupBy("acta_id").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct("fila", "columna"))),
            lambda c: F.concat(F.lit("fila"), c["fila"].cast("string"), F.lit("_col"),
                               c["columna"].cast("string")),
        ).alias("celdas_sobreescritas")
    )


def preprocess_flags(measures: DataFrame, cells: DataFrame) -> DataFrame:
    """Flags of the cleaning step: stain, overwritten cells, letters in numbers, prints."""
    stain = F.col("pre_stain_pct") > K.PRE_STAIN_PCT
    prints = F.col("print_ratio") > K.PRE_PRINT_RATIO
    suspicious = F.coalesce(F.col("campos_sospechosos"), F.array().cast("array<string>"))
    n_cells = F.size("celdas_sobreescritas")
    joined = measures.join(overwritten_cells(cells), "acta_id", "left").withColumn(
        "celdas_sobreescritas",
        F.coalesce("celdas_sobreescritas", F.array().cast("array<string>")),
    )
    overwritten = n_cells > 0
    confusion = F.size(suspicious) > 0
    notes = F.concat(
        compact(
            F.when(
                stain,
                F.concat(F.lit("MANCHA: "), F.format_string("%.1f", F.col("pre_stain_pct")),
                         F.lit("% de la imagen afectada por ruido/tinta")),
            ),
            F.when(
                overwritten,
                F.concat(F.lit("SOBREESCRITURA detectada en "), n_cells.cast("string"),
                         F.lit(" celda(s): "), F.array_join("celdas_sobreescritas", ", ")),
            ),
            F.when(
                prints,
                F.concat(F.lit("HUELLA DACTILAR detectada sobre zona de números ("),
                         F.format_string("%.1f", F.col("print_ratio") * 100), F.lit("% cubierta)")),
            ),
        ),
        F.transform(suspicious, lambda s: F.concat(F.lit("CONFUSIÓN ALFANUMÉRICA en "), s)),
    )
    return joined.select(
        "acta_id",
        stain.alias("mancha_detectada"),
        F.col("pre_stain_pct").alias("porcentaje_mancha"),
        overwritten.alias("numeros_sobreescritos"),
        "celdas_sobreescritas",
        confusion.alias("confusion_alfanumerica"),
        suspicious.alias("campos_sospechosos"),
        prints.alias("huellas_zona_numeros"),
        (stain | overwritten | confusion | prints).alias("flag_revision_manual"),
        notes.alias("observaciones"),
    )


def merge_observations(a: Column, b: Column, prefix: str = "[Python] ") -> Column:
    """Append the texts of b that a lacks, each with a prefix (repeats inside b stay)."""
    fresh = F.filter(b, lambda x: ~F.array_contains(a, x))
    return F.concat(a, F.transform(fresh, lambda x: F.concat(F.lit(prefix), x)))


def visual_observations() -> Column:
    """Observation texts of the merged flags, in order."""
    c = F.col
    return compact(
        F.when(c("lapiz_detectado"), F.concat(
            F.lit("NULIDAD — USO DE LÁPIZ: color gris "),
            F.round("intensidad_promedio").cast("int").cast("string"), F.lit("/255 detectado"))),
        F.when(c("corrector_detectado"), F.lit("NULIDAD — CORRECTOR (LIQUID PAPER) detectado")),
        F.when(c("tachadura_detectada") | c("numeros_sobreescritos"), F.lit(
            "NULIDAD — TACHADURA/SOBREESCRITURA: números superpuestos en zona de votos")),
        F.when(c("texto_anulada_visual"), F.lit(
            "NULIDAD — TEXTO 'ANULADA' escrito sobre el acta (detección visual)")),
        F.when(c("rotura_detectada"), F.lit("NULIDAD — ROTURA CRÍTICA: sección faltante del papel")),
        F.when(~c("firmas_suficientes"), F.concat(
            F.lit("NULIDAD — FIRMAS INSUFICIENTES: "), c("huellas_detectadas").cast("string"),
            F.lit(" huellas (mínimo 3)"))),
        F.when(c("mancha_detectada"), F.concat(
            F.lit("OBSERVACIÓN — MANCHA: "), F.format_string("%.1f", c("porcentaje_mancha")),
            F.lit("% del área afectada"))),
        F.when(c("arrugas_detectadas"), F.lit(
            "OBSERVACIÓN — ACTA ARRUGADA: Se detectaron variaciones de sombra por pliegues en el papel")),
        F.when(c("confusion_alfanumerica"), F.concat(
            F.lit("OBSERVACIÓN — CONFUSIÓN ALFANUMÉRICA en campos: "),
            F.array_join("campos_sospechosos", ", "))),
        F.when(c("huellas_zona_numeros"), F.lit(
            "OBSERVACIÓN — HUELLA DACTILAR detectada sobre zona de números")),
    )


def merge_visual(flags: DataFrame, pre: DataFrame) -> DataFrame:
    """Image flags with the cleaning-step flags on top (absent where that step did not run)."""
    p = pre.select("acta_id", F.struct(*[c for c in pre.columns if c != "acta_id"]).alias("_p"))
    joined = flags.join(p, "acta_id", "left")
    off = F.lit(False)
    none = F.array().cast("array<string>")
    from_pre = lambda name, default: F.coalesce(F.col(f"_p.{name}"), default)
    late_stain = from_pre("mancha_detectada", off) & ~F.col("mancha_detectada")
    out = joined.withColumns(
        {
            "porcentaje_mancha": F.when(late_stain, F.col("_p.porcentaje_mancha")).otherwise(
                F.col("porcentaje_mancha")
            ),
            "mancha_detectada": F.col("mancha_detectada") | late_stain,
            "numeros_sobreescritos": from_pre("numeros_sobreescritos", off),
            "celdas_sobreescritas": from_pre("celdas_sobreescritas", none),
            "confusion_alfanumerica": from_pre("confusion_alfanumerica", off),
            "campos_sospechosos": from_pre("campos_sospechosos", none),
            "huellas_zona_numeros": from_pre("huellas_zona_numeros", off),
            "flag_revision_manual": from_pre("flag_revision_manual", off),
            "pipeline_python_usado": F.col("_p").isNotNull(),
            "_notas": from_pre("observaciones", none),
        }
    )
    first = merge_observations(F.array().cast("array<string>"), F.col("_notas"))
    return out.withColumn("observaciones", F.concat(first, visual_observations())).drop("_p", "_notas")


def has_visual_flags(v: str = "validacion_visual") -> Column:
    """Any flag that is shown to a person; NULL struct means none."""
    f = lambda name: F.coalesce(F.col(f"{v}.{name}"), F.lit(False))
    return F.col(v).isNotNull() & (
        f("lapiz_detectado") | f("corrector_detectado") | f("tachadura_detectada")
        | f("numeros_sobreescritos") | f("confusion_alfanumerica") | f("huellas_zona_numeros")
        | f("rotura_detectada") | f("mancha_detectada") | ~f("firmas_suficientes")
    )
