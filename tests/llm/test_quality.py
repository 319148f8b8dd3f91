from collections import Counter

from tests.llm.helpers import SF, agrees, docs, odd_columns, words
from votecount.llm import quality as q

PROSE = "A plain sentence with quite a few words in it ends here. "


def test_agrees_with_sql(spark):
    agrees(q.verdicts(spark.read.parquet(f"{SF}/documents.parquet")), q.SQL)


def repeated_words(text):
    w = words(text)
    at = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(at)
    return len({j for i, g in enumerate(at) if times[g] > 1 for j in range(i, i + 5)})


def test_counts_of_awkward_texts(spark):
    texts = [
        None, "", " \n\t\n ", "one", "a b c d e", "a b c d e a b c d e", "x " * 30, "é# ü$\nü$\n\nü$",
        PROSE * 3 + "\n" + PROSE * 3, "|".join("ab") * 40, PROSE * 2000, "a\x0bb\x0cc\u00a0d\re",
    ]
    got = {r.doc_id: r for r in q.verdicts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        assert got[i].n_words == len(w)
        assert got[i].word_chars == sum(map(len, w))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].n_repeat_words == repeated_words(t)
        failed = len(w) < 10 or 100 * got[i].n_repeat_words > 20 * len(w)
        assert got[i].base_failed == failed and (not failed or not got[i].kept)


def test_lines_fail_one_by_one(spark):
    good = "The council met on Monday and voted on the new bridge over the river, which had been delayed for years."
    menu = "Home | News | Sport | Weather | Travel | Contact"
    stock = "All rights reserved. Terms of use. Privacy policy."
    shout = "BUY!! NOW!! THE!! BEST!! OFFER!! EVER!! CALL!! US!! TODAY!! OR!! NEVER!!"
    other = "Nobody had expected so many people to come, and there were not enough chairs for all of them."
    text = "\n".join([good, menu, stock, "", shout, other, other.upper()])
    df = q.clean(docs(spark, [text, menu * 3 + "\n" + good, good + "\n" + "no end of a sentence " * 20]))
    got = {r.doc_id: r["__q"] for r in df.collect()}
    assert got[0].kept and got[0].n_lines_removed == 3
    assert got[0].clean_text == "\n".join([good, "", other, other.upper()])
    assert not got[1].kept and got[1].lost_chars > got[1].word_chars / 2
    assert not got[2].kept


def test_other_columns_repeats_and_empty_tables(spark):
    base = docs(spark, [(1, PROSE * 1), (1, PROSE * 1), (None, PROSE.replace("plain", "simple"))])
    df = odd_columns(base, "n_words", "kept", "words", "h")
    kept = q.keep_clean(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert q.verdicts(df).count() == 3
    none = base.where("doc_id = 99")
    assert q.verdicts(none).count() == 0 and q.keep_clean(none).count() == 0


def test_no_python_in_the_plan(spark):
    plan = q.verdicts(docs(spark, ["a"]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
