import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.helpers import docs, odd_columns
from votecount.llm import langid as g
from votecount.llm import toxicity as t

SF01 = "/root/testdata/sf0.1"
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from or have at not they which but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec",
}


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(FUNCTION_WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = g.learn_and_identify(df).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_texts(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang, rnd.randint(3, 80)), lang) for i, lang in enumerate(list(FUNCTION_WORDS) * 60)]
    labelled = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    filters = g.fit(labelled, rows=40)
    assert filters.names == ["de", "en", "fr"]
    odd = [None, "", " \n", "123 !? 45", "…—“”", "é", "漢", sentence(rnd, "fr", 40000), "der", sentence(rnd, "de", 9)]
    df = odd_columns(docs(spark, [*odd, (3, "123"), (None, None)]), "key", "lang_pred", "score")
    got = g.identify(df, filters).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(odd) + 2
    assert [by[i].lang_pred for i in range(5)] == ["und"] * 5 and by[0].score == 0
    assert by[7].lang_pred == "fr" and by[9].lang_pred == "de" and by[6].lang_pred in filters.names
    assert g.identify(df.where("doc_id = 99"), filters).count() == 0
    nothing = g.fit(labelled.where("lang = 'xx'"))
    assert {r.lang_pred for r in g.identify(df, nothing).collect()} == {"und"}
    assert {r.score for r in g.identify(df, nothing).collect()} == {0.0}


def test_filters_hold_what_was_put_in_and_correct_the_rest():
    rnd = np.random.default_rng(3)
    sets = {f"l{i:02}": rnd.integers(0, 2**32, 3000).astype(np.uint32) for i in range(11)}
    f = g.Filters(sets, cells=1 << 14)
    for i, name in enumerate(f.names):
        hits, total = f.hits(sets[name], np.array([0, len(sets[name])]))
        assert hits[0, i] == total[0]
    fresh = rnd.integers(0, 2**32, 50_000).astype(np.uint32)
    hits, total = f.hits(fresh, np.array([0, len(fresh)]))
    assert (abs(hits[0] / total[0] - f.false) < 0.01).all()


def test_a_very_long_text_is_looked_up_whole(monkeypatch):
    rnd = random.Random(4)
    texts = [sentence(rnd, "en", 3000) + sentence(rnd, "de", 9000), "der die", None]
    sets = {lang: np.unique(g.grams(pa.array([sentence(rnd, lang, 500)]))[0]) for lang in FUNCTION_WORDS}
    f = g.Filters(sets)
    whole = f.decide(pa.array(texts))
    monkeypatch.setattr(g, "PIECE", 1000)
    parts = f.decide(pa.array(texts))
    assert whole[0] == parts[0] == ["de", "de", "und"]
    assert np.allclose(whole[1], parts[1], atol=0.01)


def test_grams_do_not_cross_texts():
    found, first = g.grams(pa.array(["ab", None, "CD1e"]))
    parts = [found[a:b] for a, b in zip(first[:-1], first[1:])]
    spelled = [{int(x).to_bytes(4, "little") for x in p} - {b"    "} for p in parts]
    assert spelled == [{b" ab "}, set(), {b" cd ", b"cd e", b"d e "}]


def test_toxicity_on_held_out_documents(spark):
    read = lambda n: spark.read.parquet(f"{SF01}/{n}.parquet")
    labels = {r.doc_id: r.toxic for r in read("labels").collect()}
    got = t.score(read("documents"), read("labels")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.predicted, r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p and y for p, _, y in held)
    assert hits / sum(y for *_, y in held) > 0.8 and hits / sum(p for p, *_ in held) > 0.9


def test_toxicity_of_awkward_texts_and_tables(spark):
    rnd = random.Random(2)
    insult = "you stupid idiot, trash and scum"
    rows = [(i, sentence(rnd, "en", 30) + (f" {insult}." if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(3, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"
    )
    odd = [(1000, None), (1001, ""), (1002, " "), (1003, insult * 3000), (1003, insult * 3000), (None, "fine words")]
    df = odd_columns(docs(spark, rows + odd), "key", "label", "features", "p", "raw")
    got = t.score(df, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert by[1003].predicted == 1 and by[1001].predicted == 0 and by[1000].score == by[1001].score
    assert not by[None].held_out and by[None].predicted == 0
    assert t.score(df.where("doc_id = -1"), labels).count() == 0
    clean = t.score(df, labels.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in clean} == {(0.0, 0)}
    assert {r.score for r in t.score(df, labels.where("doc_id = -1")).collect()} == {0.0}


def test_features():
    lexicon = {"idiot": 2.0, "lowe*": 1.5}
    f = dict(zip(t.NAMES, t.features("You IDIOT!! loweian, lowe a1b soooo", lexicon), strict=True))
    assert (f["n_words"], f["hits"], f["distinct"], f["near_second"]) == (6, 3, 3, 3)
    assert f["strongest"] == 2.0 and f["doubled"] == 1 / 6 and f["obfuscated"] == 1 / 6 and f["stretched"] == 1 / 6
    assert t.features("", lexicon) == [0.0] * len(t.NAMES)
