"""What is worked out once: parsed rows are read back from a copy, plans do not parse again."""

from pyspark.sql import functions as F

from votecount.functions.steps import once
from votecount.operators import machine as m
from votecount.operators.lineage import forget, kept
from votecount.sources.sinks import exists


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_is_built_below_the_generator(spark):
    df = once(spark.range(3), {"n": F.aggregate(F.array("id"), F.lit(0).cast("bigint"), lambda a, x: a + x)})
    generators = [line for line in plan(df).splitlines() if "Generate" in line]
    assert generators and not any("lambdafunction" in line for line in generators)
    assert sorted(r.n for r in df.collect()) == [0, 1, 2]


def test_messages_are_parsed_once(spark):
    rows = "telefono string, mensaje_raw string, fecha_recepcion timestamp, seq long"
    messages = spark.createDataFrame([], rows)
    copies = []
    judged = m.sms_outcomes(messages, m.SmsPolicy(("+1",), "1"), copies=copies)
    assert "split(mensaje_raw" not in plan(m.sms_register(judged))
    assert judged.count() == 0 and len(copies) == 1
    forget(spark, copies)
    assert not exists(spark, copies[0])


def test_only_files_that_share_a_key_are_contested(spark):
    keys = spark.createDataFrame(
        [(1, 1, "a", "x"), (2, 2, "a", "y"), (3, 3, "b", "z"), (4, 4, "c", "x"), (5, 5, "d", "w")],
        "seq long, orden long, hash_origen string, acta_id string",
    )
    got = {r.seq: (r.resultado, r.previo) for r in m.contested(kept(keys)).collect()}
    assert got == {1: (m.STORED, None), 2: (m.SAME_FILE, 1), 4: (m.SAME_SHEET, 1)}
