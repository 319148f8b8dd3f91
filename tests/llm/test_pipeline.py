import random

import corpus_pipeline as cp
from tests.llm.helpers import SF, docs, odd_columns
from votecount.llm.queries import ORACLE, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_complete():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_decisions_take_effect(spark, tmp_path):
    rnd = random.Random(9)
    prose = lambda n: " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(n)).capitalize() + "."
    passage, leak, base = prose(60), prose(40), prose(200)
    clean = [f"{prose(40)}\n{prose(50)}" for _ in range(20)]
    texts = [
        *clean, "too short.", None, f"{prose(30)}\nHome | News | Sport | Travel", base, base + " tail", base,
        f"{passage}\n{prose(40)}", f"{prose(45)}\n{passage}", f"{prose(30)} {leak}",
    ]
    folder = str(tmp_path)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd_columns(docs(spark, texts), "id", "line", "kept").write.parquet(f"{folder}/documents.parquet")
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    columns = seen.columns
    after = {}
    for name, stage in cp.STAGES:
        stage(spark, seen, folder).write.parquet(f"{folder}/{name}")
        seen = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert seen.columns == columns
        after[name] = {r.doc_id: r.asDict() for r in seen.collect()}
    text = {n: {i: r["text"] for i, r in rows.items()} for n, rows in after.items() if n != "packing"}
    gone = lambda a, b: set(a) - set(b)
    assert gone(range(len(texts)), text["quality_rules"]) == {20, 21}
    assert text["quality_rules"][22] == texts[22].split("\n")[0]
    assert after["quality_rules"][22]["n_chars"] == len(text["quality_rules"][22])
    assert gone(text["quality_rules"], text["minhash_near_dedup"]) == {24, 25}
    assert not gone(text["minhash_near_dedup"], text["substring_dedup"])
    assert text["substring_dedup"][26] == texts[26] and text["substring_dedup"][27] == texts[27].split("\n")[0]
    assert gone(text["substring_dedup"], text["benchmark_decontamination"]) == {28}
    assert all(text["benchmark_decontamination"][i] == texts[i] for i in range(20))
    assert set(after["packing"]) == set(text["benchmark_decontamination"])


def test_run_and_an_empty_table(spark, tmp_path):
    rows = cp.run(spark, SF)
    assert set(rows.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert rows.count() > 0
    folder = str(tmp_path)
    docs(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).count() == 0
