import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import ASCII, SF, agrees, docs, odd_columns
from votecount.llm import variants
from votecount.llm.common import shared_folder


def edits(word, letters):
    """Every word that is exactly one inserted, deleted or replaced letter away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b}
    out |= {a + c + b for a, b in cut for c in letters}
    out |= {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def told_plainly(rows, ratio=5, slips=199, length=6, least=5):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= least}
    letters = set("".join(n))
    near = {w: edits(w, letters) & n.keys() for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            form[w] = best if n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def found(df, **how):
    got = variants.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_agrees_with_sql(spark):
    agrees(variants.variants(spark.read.parquet(f"{SF}/documents.parquet")), variants.SQL)


def test_agrees_with_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert found(table, length=4, least=2, slips=7) == told_plainly(rows, length=4, least=2, slips=7)


def test_awkward_texts(spark):
    texts = [None, "", "  12 ", "straße " * 30 + "STRASSE strasse", "ÉCOLE école École écoles " * 6, "aaaaaa " * 9 + "aaaaaaa " * 9]
    texts += ["×÷×÷×÷ " * 7, "x" * 20000 + " " + "x" * 20001, "letter" * 3 + " letters-letter's " * 40, (None, "letterz letters " * 6)]
    texts += [(3, "letter lettor " * 50), (3, "letter lettor " * 50)]
    df = docs(spark, texts)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = found(odd_columns(df, "word", "n", "gram", "len", "form", "id", "run", "a.b"), least=1, slips=11)
    assert got == told_plainly(rows, least=1, slips=11)


@pytest.mark.parametrize("texts", [[], [None, ""], ["short words do not count"]])
def test_no_words(spark, texts):
    assert found(docs(spark, texts)) == set()


def test_chains_of_forms(spark):
    """Forms of forms are followed to the last; equal counts go to the first word."""
    words = {"abcdefg": 1, "abcdefh": 5, "abcdeih": 25, "abcjeih": 125, "abcjkih": 625, "lmnopq": 3, "lmnopr": 15, "lmnops": 15}
    df = docs(spark, [" ".join(w for w, k in words.items() for _ in range(k))])
    got = {r[0]: r for r in found(df, least=1, slips=10**12)}
    assert got["abcdefg"][1:3] == ("abcdefh", "abcjkih")
    assert got["lmnopq"][1:3] == ("lmnopr", "lmnopr")
    assert set(got.values()) == told_plainly([(0, df.first().text)], least=1, slips=10**12)


def test_one_ending_shared_by_a_third(spark):
    """Words of a dense family, with a common beginning and ending in one third of them."""
    rnd = random.Random(9)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(6, 8))) for _ in range(1500)}
    words |= {"unter" + "".join(rnd.choice("abc") for _ in range(5)) + "ungen" for _ in range(240)}
    letters = set("".join(words))
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = variants.near_pairs(df, shared_folder(spark), many=20).collect()
    got = {frozenset((r.a, r.b)) for r in pairs}
    assert len(got) == len(pairs)
    assert got == {frozenset((w, x)) for w in words for x in edits(w, letters) & words}


word = st.text("ab", min_size=1, max_size=12)


@settings(max_examples=400, deadline=None)
@given(word, st.sets(st.text("ab^$", min_size=2, max_size=4)), st.integers(0, 12), st.sampled_from(["in", "out", "for"]), st.sampled_from("abc"))
def test_an_edit_changes_no_more_grams_than_the_bound(w, grams, at, kind, letter):
    at = min(at, len(w))
    other = {"in": w[:at] + letter + w[at:], "out": w[:at] + w[at + 1 :], "for": w[:at] + letter + w[at + 1 :]}[kind]
    frequent, qmax = frozenset(grams), 5
    s, places = variants.decompose(w, frequent, qmax)
    t, others = variants.decompose(other, frequent, qmax)
    mine = {s[a:b] for a, b in places}
    assert len(mine & {t[a:b] for a, b in others}) >= len(mine) - variants.most_changed(s, places, variants._suffixes(frequent), qmax)


@settings(max_examples=300, deadline=None)
@given(word, st.integers(0, 12), st.sampled_from("abc"))
def test_one_half_is_left_whole(w, at, letter):
    at = min(at, len(w))
    for other in (w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]):
        assert set(variants.halves(w)) & set(variants.halves(other))


def test_grams_are_lengthened_only_where_frequent():
    s, places = variants.decompose("station", frozenset(["ti", "tio"]), 4)
    assert [s[a:b] for a, b in places] == ["^s", "st", "ta", "at", "tion", "n$"]


def test_check_sums_are_those_of_the_contract(spark):
    df = docs(spark, [(i, "kilometer") for i in range(600)])
    lost = {zlib.crc32(f"{i}:kilometer".encode()) % 199 for i in range(600)}
    assert 0 in lost
    assert {r.word: r.n for r in variants.counted_words(df, least=1).collect()} == dict(
        Counter(
            "kilometer" if h % 199 else "kilometer"[: h % 9] + "kilometer"[h % 9 + 1 :]
            for h in (zlib.crc32(f"{i}:kilometer".encode()) for i in range(600))
        )
    )
    assert df.select(F.crc32(F.lit("3:kilometer").cast("binary"))).first()[0] == zlib.crc32(b"3:kilometer")
