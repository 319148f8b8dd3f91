"""Message parsing and the message machine, row by row and against a sequential run."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from votecount import schemas
from votecount.functions import sms
from votecount.functions.sms import parse_sms, parse_sms_star
from votecount.operators import machine as m
from votecount.operators.events import format_error_text, notification_outbox, sms_events

T0 = datetime(2025, 8, 17, 18, 0, 0)
POLICY = m.SmsPolicy(phones=("+1", "+2"), pin="77")


def text(acta="MESA-1", val=10, nul=1, bla=2, votes=(4, 6), pin="77", rec="|REC:U.E. Sol", **extra):
    cs = "|".join(f"C{i}:{v}" for i, v in enumerate(votes, 1))
    return f"ACTA:{acta}|DEP:Beni|MUN:Trinidad{rec}|MESA:3|VAL:{val}|NUL:{nul}|BLA:{bla}|{cs}|PIN:{pin}"


def frame(spark, messages):
    rows = [(p, t, T0 + timedelta(minutes=i), i) for i, (p, t) in enumerate(messages)]
    return spark.createDataFrame(rows, schemas.SMS_MESSAGE)


def parse(spark, *texts, **kw):
    df = parse_sms(frame(spark, [("+1", t) for t in texts]), **kw)
    return df.orderBy("seq").collect()


def test_clean_message(spark):
    (r,) = parse(spark, text(votes=(1, 2, 3, 4)))
    assert r.errores_parseo == []
    assert (r.sms_acta, r.sms_dep, r.sms_mun, r.sms_rec, r.sms_mesa) == (
        "MESA-1", "Beni", "Trinidad", "U.E. Sol", "3")
    assert (r.sms_val, r.sms_nul, r.sms_bla) == (10, 1, 2)
    assert [tuple(c) for c in r.candidatos] == [("C1", 1), ("C2", 2), ("C3", 3), ("C4", 4)]


@pytest.mark.parametrize(
    "message, errors",
    [
        (text(rec=""), []),
        (text(rec="|REC:Calle 5: norte"), []),
        (text(rec="|REC sin separador"), ["campo mal formado: 'REC sin separador'"]),
        (text().replace("VAL:10|", ""), ["campo obligatorio faltante: VAL (votos válidos)"]),
        (text(val="diez"), ["VAL (votos válidos) no es número: 'diez'"]),
        (text(val="5.0"), ["VAL (votos válidos) no es número: '5.0'"]),
        (text(val="+5"), []),
        (text(val="99999999999999999999"), ["VAL (votos válidos) no es número: '99999999999999999999'"]),
        (text(acta=""), []),
        (text(votes=("x", 1)), ["votos inválidos para C1: 'x'", "candidato C1 faltante en la secuencia"]),
        (text().replace("C2:6", "C3:6"), ["candidato C2 faltante en la secuencia"]),
        (text().replace("C1:4|C2:6", "C0:9"), []),
        (text().replace("C1:4|C2:6|", ""), ["no se encontraron candidatos (C1, C2, C3...)"]),
        (text().replace("C2:6", "C99999999999999999999:6"), ["número de candidato inválido: C99999999999999999999"]),
        ("", ["campo mal formado: ''"] + [
            f"campo obligatorio faltante: {n}" for n in (
                "ACTA", "DEP (departamento)", "MUN (municipio)", "MESA", "VAL (votos válidos)",
                "NUL (votos nulos)", "BLA (votos blancos)", "PIN")
        ] + ["no se encontraron candidatos (C1, C2, C3...)"]),
    ],
)
def test_errors(spark, message, errors):
    df = parse_sms(frame(spark, [("+1", message)]))
    assert df.select(sms.first_errors(100).alias("e")).first().e == errors


def test_keys_are_trimmed_and_later_ones_win(spark):
    (r,) = parse(spark, text().replace("VAL:10", " val\t: 10 ") + "|c2:9|DEP:Pando")
    assert r.errores_parseo == []
    assert (r.sms_val, r.sms_dep, r.candidatos[1].votos) == (10, "Pando", 9)


def test_a_huge_gap_does_not_blow_up(spark):
    (r,) = parse(spark, text().replace("C2:6", "C2000000000:6"))
    assert [tuple(x) for x in r.huecos] == [(2, 1999999999)] and r.errores_parseo == []
    assert [c.candidato_id for c in r.candidatos] == ["C1", "C2000000000"]


@pytest.mark.parametrize("top", [2, 3, 7, 1002, 1003, 5002])
def test_gaps_of_any_length_obey_one_rule(spark, top):
    df = parse_sms(frame(spark, [("+1", text().replace("C2:6", f"C{top}:6"))]))
    wanted = [f"candidato C{n} faltante en la secuencia" for n in range(2, top)]
    lines = sms.error_lines(df).orderBy("orden").collect()
    assert [(r.parte, r.orden, r.error) for r in lines] == [(2, n, e) for n, e in enumerate(wanted, 2)]
    r = df.select(sms.error_count().alias("n"), sms.first_errors(3).alias("f"), sms.malformed().alias("m")).first()
    assert (r.n, r.f, r.m) == (len(wanted), wanted[:3], top > 2)
    votes = {c.candidato_id: c.votos for c in sms.candidate_lines(df).collect()}
    assert votes == {f"C{n}": {1: 4, top: 6}.get(n, 0) for n in range(1, top + 1)}


def test_lenient_reading_has_no_errors(spark):
    (r,) = parse(spark, "DEP:Beni|basura|VAL:3", strict=False)
    assert (r.sms_dep, r.sms_mun, r.sms_val) == ("Beni", None, 3)
    assert "errores_parseo" not in r.asDict()


def test_star_format(spark):
    rows = parse_sms_star(frame(spark, [("+1", "M1*10*2*1*4*6"), ("+1", "M1*10*x*1*4"), ("+1", "*1")]))
    a, b, c = rows.orderBy("seq").collect()
    assert (a.sms_acta, a.sms_val, a.sms_bla, a.sms_nul) == ("M1", 10, 2, 1)
    assert [x.votos for x in a.candidatos] == [4, 6] and a.errores_parseo == []
    assert b.errores_parseo == ["campo no numérico"]
    assert c.errores_parseo == ["falta el id de mesa", "faltan campos"]


def sequential(messages):
    """One message at a time, the way a server would: (state, stage, event kinds) per message."""
    seen, sheets, out = {}, {}, []
    for phone, t in messages:
        digest = hashlib.sha256(t.encode()).hexdigest()
        parts = dict(p.split(":", 1) for p in t.split("|") if ":" in p)
        ok = {"ACTA", "DEP", "MUN", "MESA", "VAL", "NUL", "BLA", "PIN"} <= set(parts)
        if phone not in POLICY.phones:
            seen.setdefault(digest, "")
            out.append(("RECHAZADO", "SMS_TELEFONO_NO_AUTORIZADO", "RECHAZADO"))
        elif digest in seen:
            out.append((None, "SMS_DUPLICADO", seen[digest]))
        elif not ok:
            seen[digest] = ""
            out.append(("ERROR", None, None))
        elif parts["PIN"] != POLICY.pin:
            seen[digest] = parts["ACTA"]
            out.append(("RECHAZADO", "SMS_PIN_INVALIDO", parts["ACTA"]))
        elif parts["ACTA"] in sheets:
            seen[digest] = parts["ACTA"]
            out.append(("DUPLICADO", "DUPLICADO_DETECTADO", parts["ACTA"]))
        else:
            seen[digest] = parts["ACTA"]
            sheets[parts["ACTA"]] = parts
            out.append(("PROCESADO", "ACTA_GUARDADA", parts["ACTA"]))
    return out


def crowd(n, seed):
    """Messages with one text and one sheet that hold about a third of the rows each."""
    rnd = random.Random(seed)
    hot = text("MESA-7", 10)
    out = []
    for _ in range(n):
        phone = rnd.choice(["+1", "+2", "+9"])
        t = rnd.choice([
            hot,
            text("MESA-7", rnd.randint(10, 14)),
            text(f"MESA-{rnd.randint(1, 9)}", rnd.randint(10, 12), pin=rnd.choice(["77", "77", "00"])),
            text(f"MESA-{rnd.randint(1, 9)}").replace("NUL:1|", ""),
        ])
        out.append((phone, t))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_machine_agrees_with_one_at_a_time(spark, seed):
    messages = crowd(150, seed)
    outcomes = m.sms_outcomes(frame(spark, messages), POLICY)
    got = {r.seq: r.estado_sms for r in outcomes.select("seq", "estado_sms").collect()}
    expected = sequential(messages)
    assert [got[i] for i in range(len(messages))] == [e[0] for e in expected]
    kinds = {"SMS_RECIBIDO", "INCONSISTENCIAS_DETECTADAS"}
    events = {
        r.seq: (r.tipo_evento, r.acta_id)
        for r in sms_events(outcomes).collect() if r.tipo_evento not in kinds
    }
    assert [events.get(i) for i in range(len(messages))] == [
        (e[1], e[2]) if e[1] else None for e in expected
    ]
    register = m.sms_register(outcomes).collect()
    assert len(register) == len({t for _, t in messages})
    sheets = m.sms_sheets(outcomes).collect()
    assert len({s.acta_id for s in sheets}) == len(sheets)


def test_refused_text_blocks_the_same_text_from_a_known_phone(spark):
    outcomes = m.sms_outcomes(frame(spark, [("+9", text()), ("+1", text())]), POLICY)
    first, second = outcomes.orderBy("seq").collect()
    assert first.estado_sms == "RECHAZADO" and second.etapa == m.BY_HASH


def test_conflicting_numbers_are_logged(spark):
    outcomes = m.sms_outcomes(frame(spark, [("+1", text(val=10)), ("+2", text(val=11))]), POLICY)
    issues = m.issues_of(outcomes).collect()
    conflict = [i for i in issues if i.tipo == "DUPLICADO_DATOS_DIFERENTES"]
    assert [i.descripcion for i in conflict] == [
        "Acta recibida con anterioridad y datos no coinciden: votos_validos: anterior=10, nuevo=11"]
    assert conflict[0].metadata["diferencias"] == "votos_validos: anterior=10, nuevo=11"


def test_outbox(spark):
    bad = text().replace("VAL:10|", "").replace("NUL:1|", "").replace("BLA:2|", "")
    outcomes = m.sms_outcomes(frame(spark, [("+1", text()), ("+1", bad), ("+9", text("MESA-2"))]), POLICY)
    a, b = notification_outbox(outcomes).orderBy("seq").collect()
    assert a.mensaje.endswith("recibida y procesada correctamente.")
    assert b.resumen.endswith("(y 1 más)")


def test_long_error_text_is_cut_at_1600_bytes(spark):
    row = spark.range(1).select(F.array(F.repeat(F.lit("ñ"), 2000)).alias("e"))
    (r,) = row.select(format_error_text(F.col("e")).alias("t")).collect()
    assert r.t.endswith("...") and len(r.t.encode()) <= 1602
