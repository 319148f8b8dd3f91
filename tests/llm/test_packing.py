import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import SF, docs, odd_columns
from votecount.llm import packing as p
from votecount.llm.tokens import vocabulary

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(NAME))


def check(rows, texts, library, capacity=2048):
    """Every id in exactly one piece, pieces as they say, sequences gapless and within bounds; the padding."""
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id][r.start : r.start + r.length] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((x == 1).all() for x in seen.values())
    fill = {}
    for s, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        fill[s] = at
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in fill.values()) / max(1, sum(fill.values()))


def test_whole_table(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    assert check(p.pack(df.repartition(5), NAME).collect(), texts, library) < 0.05
    assert check(p.pack(df, NAME).collect(), texts, library) < 0.02


def test_awkward_texts(spark, library):
    rnd = random.Random(4)
    odd = ["a", "B", "ß", "İ", "Σ", "ΑΣ", "é", "e\u0301", "\u0301", "漢字", "😀", "1", "12", "!!", "'s", "'", ".", " ", "\n", "\u00a0", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rnd.choices(odd, k=rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "Word, word! WORD?", "a" * 3000, "some words " * 4000, "ÀÉÎ,", "naïve..."]
    rows = p.pack(docs(spark, texts), NAME).collect()
    check(rows, dict(enumerate(texts)), library)


def test_windows_are_bounded_and_best_fit():
    out = []
    w = p.Windows(out.append, capacity=100, n=2)
    for doc, n in enumerate([60, 70, 35, 50]):
        w.put(doc, np.arange(n))
        assert len(w.held) <= 2
    # 35 went where it left the smaller gap; 50 fits nowhere, and that gap is not worth a cut.
    assert [[(x[0], len(x[2])) for x in s] for s in out] == [[(0, 60), (2, 35)]]
    left = w.close()
    pieces = [x for s in [*out, left] for x in s]
    assert sum(len(x[2]) for x in pieces) == 215 and all(sum(len(x[2]) for x in s) <= 100 for s in out)


def test_merging_moves_whole_windows():
    groups = list(p.merge([(60, "a"), (50, "b"), (40, "c"), (50, "d"), (10, "e")], 100))
    assert sorted(map(sorted, groups)) == [["a", "c"], ["b", "d"], ["e"]]


def test_repeats_nulls_and_empty_tables(spark):
    df = odd_columns(docs(spark, [(1, "a b"), (1, "a b"), (None, None)]), "key", "start", "window", "fill")
    got = p.pack(df, NAME).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got) == [(0, 1, 1), (1, 3, 3), (1, 3, 3)]
    assert p.pack(df.where("doc_id = 9"), NAME).count() == 0
