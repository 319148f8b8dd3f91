"""Election tables derived from the general test tables.

The test tables hold orders, lines and customers; this module reads them as an election, by
rules that a plain SQL engine can repeat: orders are tally sheets, lines are votes,
customers are polling places, nations and regions the territory. Remainders of the order
key plant every kind of defect. Nothing here limits or samples the tables.

``k`` is the order key throughout; the sheet code is ``CODE_BASE + k`` (13 digits).
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.functions.sheet_text import parse_sheet_text
from votecount.functions.visual import merge_visual, preprocess_flags, visual_flags
from votecount.operators.machine import SmsPolicy, sms_outcomes
from votecount.operators.inconsistencies import detect_all, reference_from_wide
from votecount.operators.validation import validate_sheets
from votecount.session import configure

CODE_BASE = 1010200000000
POLICY = SmsPolicy(phones=tuple(f"+5917000000{i}" for i in range(7)), pin="4821")
WRONG_PIN = "0000"
UNKNOWN_PHONE = "+59199999999"
LOOKALIKE_RENDERING = ("0158", "OlSB")


def every(n: int) -> Column:
    return F.col("k") % n == 0


def flag(n: int, amount: int = 1) -> Column:
    return F.when(every(n), amount).otherwise(0)


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Election:
    """Lazily built frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- dimensions ------------------------------------------------------------

    @cached_property
    def territory(self) -> DataFrame:
        """Departments carry names of the list, but for one that no map knows."""
        key = F.col("r_regionkey")
        department = (
            F.when(key == 0, "Chuquisaca")
            .when(key == 1, "La Paz")
            .when(key == 2, "Cochabamba")
            .when(key == 3, "Potosí")
            .otherwise("Exterior")
        )
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("codigo_territorial"),
            department.alias("departamento"),
            F.col("n_name").alias("municipio"),
        )

    @cached_property
    def precincts(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("codigo_recinto"),
            F.col("c_name").alias("recinto"),
            F.col("c_nationkey").alias("codigo_territorial"),
            F.col("c_mktsegment").alias("provincia"),
        )

    @cached_property
    def places(self) -> DataFrame:
        return self.precincts.join(self.territory, "codigo_territorial")

    # --- official count ----------------------------------------------------------

    @cached_property
    def vote_lines(self) -> DataFrame:
        """Long votes: slot 1 to 4 are parties, 5 is blank, 6 and 7 are null."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("k"),
            (F.col("l_orderkey") + CODE_BASE).alias("codigo_acta"),
            F.col("l_linenumber").alias("id_partido"),
            F.col("l_quantity").cast("int").alias("cantidad_votos"),
        )

    @cached_property
    def tallies(self) -> DataFrame:
        """Every sheet with its counts, before it is placed on the map."""
        slot = lambda *n: F.sum(
            F.when(F.col("id_partido").isin(*n), F.col("cantidad_votos")).otherwise(0)
        )
        lines = self.vote_lines.groupBy("k").agg(
            *[slot(i).alias(f"P{i}") for i in range(1, 5)],
            slot(5).alias("votos_blancos"),
            slot(6, 7).alias("votos_nulos"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("codigo_recinto"),
            F.col("o_orderdate").cast("timestamp").alias("_dia"),
            F.col("o_orderpriority").alias("_prioridad"),
        )
        zero = F.lit(0).cast("bigint")
        counts = [*K.PARTY_COLUMNS, "votos_blancos", "votos_nulos"]
        out = orders.join(lines, "k", "left").withColumns(
            {c: F.coalesce(c, zero) for c in counts}
        )
        out = out.withColumn("votos_validos", F.expr("P1 + P2 + P3 + P4") + flag(50))
        out = out.withColumn(
            "papeletas_anfora",
            F.expr("votos_validos + votos_blancos + votos_nulos") + flag(80, 2),
        )
        registered = F.when(
            every(45), F.greatest(F.col("papeletas_anfora") - 4, zero)
        ).otherwise(F.col("papeletas_anfora") + F.col("k") * 31 % 60)
        out = out.withColumn("votantes_habilitados", registered)
        return out.withColumns(
            {
                "codigo_acta": F.col("k") + CODE_BASE,
                "nro_mesa": (F.col("k") % 60 + 1).cast("int"),
                "papeletas_no_utilizadas": F.col("votantes_habilitados")
                - F.col("papeletas_anfora")
                + flag(70, 3),
                "apertura_hora": F.when(every(40), "0").otherwise("8"),
                "cierre_hora": F.lit("16"),
            }
        )

    @cached_property
    def transcriptions(self) -> DataFrame:
        """Wide official rows with their place names."""
        return self.tallies.join(self.places, "codigo_recinto").drop("_dia", "_prioridad")

    @cached_property
    def mesas(self) -> DataFrame:
        return self.tallies.select("codigo_acta", "codigo_recinto", "nro_mesa", "votantes_habilitados")

    @cached_property
    def official_sheets(self) -> DataFrame:
        return self.tallies.select(
            "codigo_acta", "votos_validos", "votos_blancos", "votos_nulos", "papeletas_anfora",
            "papeletas_no_utilizadas", "apertura_hora", "cierre_hora",
        )

    @cached_property
    def submitted(self) -> DataFrame:
        """Rows as the robot submits them: some twice, some under a rounded unknown code."""
        codes = F.when(every(75), F.lit(2000000000000) + F.col("k") % 4 * 10000000).otherwise(
            F.col("codigo_acta")
        )
        rows = self.tallies.withColumn(
            "copia", F.explode(F.when(every(33), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        return rows.select(
            (F.col("k") * 2 + F.col("copia")).alias("fila"),
            codes.alias("codigo_acta"),
            "codigo_recinto",
            *[F.col(p).alias(p.lower()) for p in K.PARTY_COLUMNS],
            "votos_validos", "votos_blancos", "votos_nulos", "papeletas_anfora",
            "papeletas_no_utilizadas", "apertura_hora", "cierre_hora",
        )

    @cached_property
    def transcribed(self) -> DataFrame:
        """Sheets already in the official store: those whose order was fulfilled."""
        return (
            self.table("orders")
            .where(F.col("o_orderstatus") == "F")
            .select((F.col("o_orderkey") + CODE_BASE).alias("codigo_acta"))
        )

    @cached_property
    def reference(self) -> DataFrame:
        return reference_from_wide(self.tallies)

    # --- quick count ---------------------------------------------------------------

    @cached_property
    def reports(self) -> DataFrame:
        """Quick-count reports before they take the form of a sheet, a text or a message."""
        kind = (
            F.when(F.col("_prioridad").isin("1-URGENT", "2-HIGH"), K.SMS)
            .when(F.col("_prioridad") == "3-MEDIUM", K.IMAGEN)
            .otherwise(K.PDF)
        )
        arrival = F.timestamp_seconds(F.unix_seconds("_dia") + F.col("k") * 37 % 86400)
        return (
            self.tallies.withColumns(
                {"tipo_entrada": kind, "fecha_recepcion": arrival, "c1": F.col("P1") + flag(25)}
            )
            .join(self.places, "codigo_recinto")
        )

    @cached_property
    def raw_sheets(self) -> DataFrame:
        """Sheets of all channels before validation."""
        visual = F.when(
            F.col("tipo_entrada") != K.SMS,
            F.struct(
                every(53).alias("lapiz_detectado"),
                F.when(every(53), 153.3).otherwise(0.0).alias("intensidad_promedio"),
                F.when(every(53), 0.412).otherwise(0.0).alias("ratio_contraste"),
                every(41).alias("mancha_detectada"),
                F.when(every(41), 4.3).otherwise(0.0).alias("porcentaje_mancha"),
                F.when(every(59), 2).otherwise(5).alias("huellas_detectadas"),
                (~every(59)).alias("firmas_suficientes"),
                F.lit(False).alias("corrector_detectado"),
                every(61).alias("tachadura_detectada"),
                every(67).alias("rotura_detectada"),
                every(71).alias("texto_anulada_visual"),
            ),
        )
        votes = [F.col("c1"), F.col("P2"), F.col("P3"), F.col("P4")]
        candidates = F.array(
            *[
                F.struct(F.lit(f"C{i}").alias("candidato_id"), v.cast("bigint").alias("votos"))
                for i, v in enumerate(votes, 1)
            ]
        )
        return self.reports.select(
            "k",
            F.concat(F.lit("MESA-"), text("codigo_acta")).alias("acta_id"),
            text("codigo_acta").alias("codigo_mesa"),
            "departamento", "provincia",
            F.when(every(97), "").otherwise(F.col("municipio")).alias("municipio"),
            "recinto",
            text("nro_mesa").alias("mesa"),
            candidates.alias("candidatos"),
            "votos_validos", "votos_nulos", "votos_blancos",
            (F.expr("votos_validos + votos_blancos + votos_nulos") + flag(110)).alias("total_votos"),
            (F.col("votantes_habilitados") + flag(60, 5)).alias("electores_habilitados"),
            (F.col("papeletas_anfora") + flag(90)).alias("papeletas_anfora"),
            F.greatest("papeletas_no_utilizadas", F.lit(0)).alias("papeletas_no_utilizadas"),
            F.lit(None).cast("string").alias("estado"),
            F.lit("").alias("motivo_estado"),
            F.lit(K.RRV).alias("fuente"),
            "tipo_entrada",
            F.sha2(text("codigo_acta"), 256).alias("hash_origen"),
            visual.alias("validacion_visual"),
            "fecha_recepcion",
        )

    @cached_property
    def sheets(self) -> DataFrame:
        return validate_sheets(self.raw_sheets)

    @cached_property
    def arriving(self) -> DataFrame:
        """Sheets reported once or, in part, a second time with other numbers."""
        again = every(21)
        rows = self.raw_sheets.withColumn(
            "copia", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        second = F.col("copia") == 1
        changed = F.when(second & every(2), 3).otherwise(0)
        return rows.withColumns(
            {
                "seq": F.col("k") * 2 + F.col("copia"),
                "fecha_recepcion": F.timestamp_seconds(
                    F.unix_seconds("fecha_recepcion") + F.col("copia") * 3600
                ),
                "votos_validos": F.col("votos_validos") + changed,
                "departamento": F.when(second & every(5), "Tarija").otherwise(F.col("departamento")),
                "hash_origen": F.concat("hash_origen", F.lit("-"), text("copia")),
            }
        )

    @cached_property
    def inconsistencies(self) -> DataFrame:
        """Log of all four detectors over the stored sheets (one sheet per id)."""
        rows = self.sheets.withColumn(
            "previa",
            F.lit(None).cast(
                "struct<votos_validos:bigint,votos_nulos:bigint,votos_blancos:bigint,"
                "departamento:string,hash_origen:string>"
            ),
        ).withColumn("canal", F.when(F.col("tipo_entrada") == K.SMS, K.SMS).otherwise("UPLOAD"))
        return detect_all(rows, self.reference)

    # --- messages ------------------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        """Text messages: copy 1 repeats the text, copy 2 sends other numbers for the sheet."""
        copies = F.array_compact(
            F.array(F.lit(0), F.when(every(20), 1), F.when(every(55), 2))
        )
        rows = self.reports.where(F.col("tipo_entrada") == K.SMS).withColumn(
            "copia", F.explode(copies)
        )
        corrected = F.when(F.col("copia") == 2, 2).otherwise(0)
        valid, first = F.col("votos_validos") + corrected, F.col("c1") + corrected
        key = lambda name: F.when(every(43), f" {name.lower()} ").otherwise(name)
        part = lambda name, value: F.concat(key(name), F.lit(":"), value)
        place = F.when(every(47), F.concat(F.lit("REC "), "recinto")).otherwise(
            part("REC", F.col("recinto"))
        )
        nulls = F.when(every(49), F.concat(F.lit("x"), text("votos_nulos"))).otherwise(text("votos_nulos"))
        body = F.array_compact(
            F.array(
                part("ACTA", F.concat(F.lit("MESA-"), text("codigo_acta"))),
                part("DEP", F.col("departamento")),
                part("MUN", F.col("municipio")),
                place,
                part("MESA", text("nro_mesa")),
                F.when(~every(45), part("VAL", text(valid))),
                part("NUL", nulls),
                part("BLA", text("votos_blancos")),
                part("C1", text(first)),
                part("C2", text("P2")),
                F.when(~every(51), part("C3", text("P3"))),
                part("C4", text("P4")),
                part("PIN", F.when(every(30), WRONG_PIN).otherwise(POLICY.pin)),
            )
        )
        delay = F.when(F.col("copia") == 1, 600).when(F.col("copia") == 2, 7200).otherwise(0)
        known = F.concat(F.lit("+5917000000"), text(F.col("k") % 7))
        return rows.select(
            "k",
            "copia",
            F.when(every(35) & (F.col("copia") == 0), UNKNOWN_PHONE).otherwise(known).alias("telefono"),
            F.array_join(body, "|").alias("mensaje_raw"),
            F.timestamp_seconds(F.unix_seconds("fecha_recepcion") + delay).alias("fecha_recepcion"),
            (F.col("k") * 4 + F.col("copia")).alias("seq"),
        )

    @cached_property
    def judged_messages(self) -> DataFrame:
        return sms_outcomes(
            self.messages.select("telefono", "mensaje_raw", "fecha_recepcion", "seq"),
            POLICY,
            self.reference,
        )

    # --- files -----------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        """Extracted texts: copy 1 is the same file again, copy 2 a corrected one."""
        copies = F.array_compact(F.array(F.lit(0), F.when(every(22), 1), F.when(every(44), 2)))
        rows = self.reports.where(F.col("tipo_entrada") != K.SMS).withColumn(
            "copia", F.explode(copies)
        )
        corrected = F.when(F.col("copia") == 2, 2).otherwise(0)
        # Three digits at least; a wider number is left whole.
        digits = lambda c: F.lpad(text(c), F.greatest(F.length(text(c)), F.lit(3)), F.lit("0"))

        def spaced(c):
            d = digits(c)
            drawn = F.regexp_replace(d, r"\B", " ")
            return F.when(every(13), F.translate(drawn, *LOOKALIKE_RENDERING)).otherwise(drawn)

        zero = F.lit(0).cast("bigint")
        unused = F.greatest(F.col("papeletas_no_utilizadas"), zero)
        admin = [F.col("votantes_habilitados"), F.col("papeletas_anfora"), unused]
        votes = [F.col("c1") + corrected, F.col("P2"), F.col("P3"), F.col("P4")]
        totals = [F.col("votos_validos") + corrected, F.col("votos_blancos"), F.col("votos_nulos")]
        code = F.when(~every(17), text("codigo_acta"))
        table = text("nro_mesa")
        town = F.replace(F.col("municipio"), F.lit("_"), F.lit(" "))
        void = F.when(every(37), F.lit("ANULADA"))
        embedded = F.array_compact(
            F.array(
                F.lit(K.EMBEDDED_MARKER),
                F.col("departamento"), F.col("provincia"), F.col("municipio"), F.lit("Local"),
                F.concat(F.lit("Calle "), "recinto"), F.lit(""), code, F.lit(" "),
                F.when(~every(23), table), void,
                *[spaced(c) for c in admin],
                *[F.when(~every(83), spaced(c)) for c in votes],
                *[spaced(c) for c in totals],
            )
        )
        # A third of the readings lack one candidate's triplet line, so names are used.
        named = every(29)
        label = lambda name, value: F.concat(F.lit(name), value)
        by_name = [
            label("DAENERYS TARGARYEN : ", digits(votes[0])),
            label("Sansa Stork ", digits(votes[1])),
            label("Robert BARATHEON  ", digits(votes[2])),
        ]
        ocr = F.array_compact(
            F.array(
                F.lit("ACTA DE ESCRUTINIO Y CONTEO"),
                label("CÓDIGO DE MESA: ", code),
                label("NÚMERO DE MESA: ", table),
                F.when(~every(31), label("Departamento : ", F.col("departamento"))),
                label("Provincia : ", F.col("provincia")),
                label("Municipio : ", town),
                label("Localidad : ", F.lit("Centro")),
                label("Recinto : ", F.col("recinto")),
                F.when(every(31), label("Jurado de ", F.col("departamento"))),
                void,
                *[F.when(~named, label("dato: ", spaced(c))) for c in admin],
                *[F.when(~named, label("casilla: ", spaced(c))) for c in votes],
                *[F.when(~named, label("total: ", spaced(c))) for c in totals],
                *[F.when(named, line) for line in by_name],
                *[
                    F.when(named, label(name, digits(c)))
                    for name, c in zip(("VOTOS VÁLIDOS: ", "VOTOS BLANCOS: "), totals)
                ],
            )
        )
        pdf = F.col("tipo_entrada") == K.PDF
        suffix = F.when(F.col("copia") == 2, "_v2").otherwise("")
        name = F.when(every(19), F.concat(F.lit("scan_"), text("k"), suffix, F.lit(".pdf"))).otherwise(
            F.concat(F.lit("acta_"), text("codigo_acta"), suffix, F.lit(".pdf"))
        )
        delay = F.when(F.col("copia") == 1, 900).when(F.col("copia") == 2, 1800).otherwise(0)
        return rows.select(
            "k",
            "copia",
            F.col("tipo_entrada").alias("origen"),
            name.alias("file_name"),
            F.array_join(F.when(pdf, embedded).otherwise(ocr), "\n").alias("text"),
            F.timestamp_seconds(F.unix_seconds("fecha_recepcion") + delay).alias("fecha_recepcion"),
            (F.col("k") * 4 + F.col("copia")).alias("seq"),
        )

    @cached_property
    def parsed_files(self) -> DataFrame:
        return parse_sheet_text(self.files.withColumn("hash_origen", F.sha2("text", 256)))

    # --- images -------------------------------------------------------------------------

    @cached_property
    def cells(self) -> DataFrame:
        """Ink per number cell: one vote line is one cell of the sheet's 14 by 3 grid."""
        return self.table("lineitem").select(
            F.concat(F.lit("MESA-"), text(F.col("l_orderkey") + CODE_BASE)).alias("acta_id"),
            (F.col("l_partkey") % 14 + 1).cast("int").alias("fila"),
            (F.col("l_linenumber") % 3 + 1).cast("int").alias("columna"),
            (F.col("l_quantity") / 100.0).alias("density"),
            (F.col("l_suppkey") % 8).cast("int").alias("branches"),
        )

    @cached_property
    def measurements(self) -> DataFrame:
        """Image measurements per order, taken from its keys and its densest line."""
        dense = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("k"))
            .agg((F.max("l_quantity") / 100.0).alias("max_cell_density"))
        )
        share = lambda n, m, d: (F.col("k") * n % m / F.lit(float(d)))
        orders = self.table("orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
        letters = F.when(every(26), F.array(F.lit("mesa='1X'→'1?'"))).otherwise(
            F.array().cast("array<string>")
        )
        return orders.join(dense, "k", "left").select(
            "k",
            F.concat(F.lit("MESA-"), text(F.col("k") + CODE_BASE)).alias("acta_id"),
            F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW").alias("programmatic"),
            share(7, 11, 10).alias("gray_fill"),
            share(3, 23, 1).alias("center_black_pct"),
            F.coalesce("max_cell_density", F.lit(0.0)).alias("max_cell_density"),
            share(13, 50, 10).alias("stain_pct"),
            share(5, 29, 1).alias("corner_dark_pct"),
            share(11, 37, 100).alias("margin_shadow_ratio"),
            share(17, 70, 100).alias("blank_block_ratio"),
            (F.col("k") * 101 % 8000).alias("print_pixels"),
            share(19, 25, 10).alias("pre_stain_pct"),
            share(29, 60, 1000).alias("print_ratio"),
            letters.alias("campos_sospechosos"),
            (~every(4)).alias("paso_limpieza"),
        )

    @cached_property
    def cleaned(self) -> DataFrame:
        """Images that the cleaning step has measured: the sheets of three in four tables."""
        return self.measurements.where("paso_limpieza")

    @cached_property
    def file_flags(self) -> DataFrame:
        """Merged image flags per uploaded file, by the hash of its content."""
        flags = merge_visual(visual_flags(self.measurements), preprocess_flags(self.cleaned, self.cells))
        code = F.concat(F.lit("MESA-"), text(F.col("k") + CODE_BASE))
        contents = self.files.select(F.sha2("text", 256).alias("hash_origen"), code.alias("acta_id")).distinct()
        return contents.join(flags, "acta_id").drop("acta_id")

    # --- events -------------------------------------------------------------------------

    @cached_property
    def event_log(self) -> DataFrame:
        """Audit events; user n is the n-th sheet."""
        return self.table("events").select(
            "event_id",
            F.concat(F.lit("MESA-"), text(F.col("user_id") + CODE_BASE)).alias("acta_id"),
            F.col("event_type").alias("tipo_evento"),
            F.col("props").alias("descripcion"),
            F.col("ts").cast("timestamp").alias("fecha"),
        )
