import random

import numpy as np
import pytest

from tests.llm.helpers import SF, agrees, components, docs, odd_columns, shingles
from votecount.llm import components as c
from votecount.llm import minhash as m
from votecount.llm import setlinks as s
from votecount.llm.words import BETWEEN_SPACES, shingle_sets, words_of


def test_agrees_with_sql(spark):
    agrees(m.groups(spark.read.parquet(f"{SF}/documents.parquet")), m.SQL)


def family(rnd, n, words, edits, base=None):
    base = base or [f"w{rnd.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(words)] = f"e{rnd.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def brute(texts, pct=85):
    sets = [shingles(t) for t in texts]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i] and sets[j]) and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both)

    return sets, components(len(texts), linked)


@pytest.mark.parametrize("blocks", [None, 20])
def test_families_of_near_copies(spark, monkeypatch, blocks):
    """Similarities on both sides of the threshold; with small blocks a cluster is cut into many."""
    if blocks:
        monkeypatch.setattr(s, "BLOCK_MEMBERS", blocks)
        monkeypatch.setattr(s, "BLOCK_SHINGLES", 2000)
    rnd = random.Random(8)
    texts = family(rnd, 120, 150, 5) + family(rnd, 40, 40, 2) + family(rnd, 30, 400, 14) + family(rnd, 10, 8, 1)
    texts += [texts[0]] * 30 + [texts[0].upper(), " ".join(texts[1].split()) + " \n"]
    texts += [None, "", "  ", "a b c", "A  B\nc", "a b", "one"] + [f"{x} tail{i}" for i, x in enumerate(texts[:20])]
    rnd.shuffle(texts)
    got = {r.doc_id: r for r in m.groups(docs(spark, texts)).collect()}
    sets, roots = brute(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), roots[i], roots[i] == i), texts[i]


def test_ids_that_repeat_or_lack(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    df = docs(spark, [(5, text), (5, text), (7, text + " x"), (None, text), (9, other), (9, text), (None, "alone again here now then"), (None, None)])
    df = odd_columns(df, "id", "n", "bands", "component", "kept")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in m.groups(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 9, True)]
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(0, ""), (0, "alone again here now then"), (5, text), (9, other)]
    )
    assert m.groups(df.where("doc_id = 99")).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for share in (0.0, 0.4, 0.85, 1.0):
        n = 2000
        common = rnd.integers(1, 2**63, round(2 * n * share / (1 + share)), dtype=np.uint64)
        rest = lambda: rnd.integers(1, 2**63, n - len(common), dtype=np.uint64)
        a, b = (np.concatenate([common, rest()]) * np.uint64(2) for _ in range(2))
        rows.append((share, *(m.packed(s.minima(x, m.HASHES)).tolist() for x in (a, b))))
    for share, a, b in rows:
        e = m.estimates(np.array([a, b]))
        assert abs(e[0, 1] - share) < 0.15 and e[0, 0] == e[1, 1] == 1
        assert share == 0.4 or m.hopeful([a, b], 85)[0, 1] == (share > 0.5)


def test_tuning_reaches_the_recall():
    for threshold, recall, hashes in ((0.85, 0.999999, 192), (0.8, 0.999, 64), (0.5, 0.9, 64)):
        bands, rows = s.tune(threshold, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - threshold**rows) ** bands >= recall
        assert 1 - (1 - threshold ** (rows + 1)) ** (hashes // (rows + 1)) < recall


def test_words_and_shingles_of_odd_texts():
    import pyarrow as pa

    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["a", "B", "é", " ", "\n", "\x0b", " ", "漢"], k=rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "x" * (3 << 20), "word " * 400000]
    found = shingle_sets(words_of(pa.array(texts, pa.string()).slice(0), BETWEEN_SPACES), 5)
    known = {}
    for t, got in zip(texts, found, strict=True):
        wanted = shingles(t)
        assert len(wanted) == len(got) == len(set(got.tolist()))
        key = frozenset(got.tolist())
        assert known.setdefault(wanted, key) == key
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_paths_stars_and_random_links(spark, tmp_path, seed):
    rnd = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(3, 3), (None, 4)]
    got = c.components(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "c")).collect()
    real = [x for x in links if None not in x and x[0] != x[1]]
    nodes = sorted({n for x in real for n in x})
    at = {n: i for i, n in enumerate(nodes)}
    pairs = {frozenset((at[a], at[b])) for a, b in real}
    roots = components(len(nodes), lambda i, j: frozenset((i, j)) in pairs)
    assert {r.node: r.component for r in got} == {n: nodes[roots[at[n]]] for n in nodes}


def test_no_links_at_all(spark, tmp_path):
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert c.components(none, str(tmp_path / "c")).columns == ["node", "component"]
    assert c.components(none, str(tmp_path / "d")).count() == 0


def test_near_copies_that_meet_through_an_unlike_hub(spark, monkeypatch):
    """One band for all: each bucket is named by a hub of similarity 0.3 to the pairs that meet in it."""
    monkeypatch.setattr(m, "band_keys", lambda lows, bands, rows: np.zeros(1, np.int64))
    rnd = random.Random(16)
    common = [f"c{i}" for i in range(100)]
    own = lambda k: [f"x{rnd.randint(0, 10**9)}" for _ in range(k)]
    texts = [" ".join(common + own(110))]
    for _ in range(20):
        base = common + own(110)
        texts += [" ".join(base), " ".join(base[:-8] + own(8))]
    sets, roots = brute(texts)
    assert 0.25 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.35
    got = {r.doc_id: r.component_id for r in m.groups(docs(spark, texts)).collect()}
    assert got == dict(enumerate(roots)) and len(set(roots)) == 21


def test_rows_without_ids_are_grouped(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs(spark, [(None, text), (None, text), (None, text + " x"), (None, "something else that is alone here"), (3, None), (None, "")])
    kept = [r.text for r in m.keep_one(df).collect()]
    assert len(kept) == 4 and sum((t or "").startswith("w0") for t in kept) == 1
    assert {r.component_id for r in m.groups(df).collect()} == {None, 3}


def test_many_repeated_rows_are_one(spark):
    """Fifty thousand equal rows and a near copy: exact links see two sets."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(50000).selectExpr("7L AS doc_id", f"'{text}' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    near = docs(spark, [(3, text + " x"), (9, "quite another text of some words")])
    df = rows.unionByName(near)
    kept = m.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]
    found = m.groups(df)
    assert {(r.doc_id, r.component_id) for r in found.distinct().collect()} == {(7, 3), (3, 3), (9, 9)}


def test_pairs_ruled_out_by_their_estimate_are_not_compared(monkeypatch):
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(1, 2**62, 300, dtype=np.uint64)) for _ in range(40)]
    sets += [np.sort(np.concatenate([x[8:], rnd.integers(1, 2**62, 8, dtype=np.uint64)])) for x in sets]
    bits = [m.packed(s.minima(x, m.HASHES)).tolist() for x in sets]
    compared = []
    plain = s.common_counts
    monkeypatch.setattr(s, "common_counts", lambda items: (compared.append(len(items)), plain(items))[1])
    ids = np.arange(80)
    with_estimate = s.forest(ids, sets, 85, m.hopeful(bits, 85))
    assert compared == [2] * 40
    assert with_estimate == s.forest(ids, sets, 85) == (list(range(40, 80)), list(range(40)))
