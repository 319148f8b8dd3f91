import hashlib
import random

from tests.llm.helpers import ASCII, SF, TOKEN, agrees, docs, odd_columns
from votecount.llm import decontaminate as d


def items(spark, texts):
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_agrees_with_sql(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    agrees(d.verdicts(read("documents"), read("benchmark")), d.SQL)


def brute(text, benchmark):
    cut = lambda t: TOKEN.findall((t or "").translate(ASCII))
    w, hit, ids = cut(text), set(), set()
    for item, t in benchmark:
        p = cut(t)
        m = min(10, len(p))
        windows = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                if item is not None:
                    ids.add(str(item))
    ids = ",".join(sorted(ids))
    return len(w), len(hit), ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def check(spark, texts, benchmark, **options):
    got = {r.doc_id: r for r in d.verdicts(docs(spark, texts), items(spark, benchmark), **options).collect()}
    rows = [b if isinstance(b, tuple) else (i, b) for i, b in enumerate(benchmark)]
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, rows), (i, t)


def test_random_words_of_a_small_alphabet(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["a", "b", "A", "é", "x1", "0"])
    text = lambda n: "".join(word() + rnd.choice([" ", ", ", "\n", "_", "\x7f"]) for _ in range(n))
    benchmark = [text(rnd.choice([10, 12, 25])) for _ in range(12)] + [text(7), text(3), "", None, "!!"]
    benchmark += [(5, text(11)), (None, text(12)), (5, text(11))]
    texts = [text(rnd.choice([0, 1, 9, 10, 40, 900])) for _ in range(60)]
    texts += [f"x {benchmark[i]} y" for i in range(12)] + [None, "", benchmark[0], text(300) + benchmark[1]]
    check(spark, texts, benchmark)
    check(spark, texts, benchmark, group_bytes=100)


def test_short_items_of_every_length(spark):
    words = [f"w{i}" for i in range(40)]
    benchmark = [" ".join(words[i : i + i % 10 + 1]) for i in range(12)]
    check(spark, [" ".join(words), " ".join(words[::-1]), "w3", "W3 w4", " ".join(words) * 3], benchmark)


def test_dropping_keeps_columns_and_clean_rows(spark):
    leak = "one two three four five six seven eight nine ten"
    df = odd_columns(docs(spark, ["clean text", f"says: {leak.upper()}.", None, (2, "again"), (None, leak)]), "item_id", "hits")
    kept = d.drop_contaminated(df, items(spark, [leak]))
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(0, "clean text"), (2, ""), (2, "again")]
    assert d.drop_contaminated(df, items(spark, []).where("item_id is null")).count() == 5
    assert d.verdicts(df.where("doc_id = 77"), items(spark, [leak])).count() == 0
