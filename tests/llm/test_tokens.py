import random

import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import SF, docs, odd_columns
from votecount.llm import tokens as t

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(t.vocabulary(NAME))


def test_whole_table_as_the_library_counts(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = {r.doc_id: r.text for r in df.collect()}
    for r in t.count_tokens(df, NAME).collect():
        n = len(library.encode(wanted[r.doc_id], add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(wanted[r.doc_id].encode()), n > 512)


def test_awkward_texts(spark, library):
    rnd = random.Random(5)
    odd = ["a", "b's", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x0b", "\x1c", "é", "e\u0301", "漢字", "😀", "1", "!!", "'", "<|endoftext|>", "don't"]
    texts = ["".join(rnd.choices(odd, k=rnd.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " ", "x" * 5000, "word " * 5000, "漢" * 3000, " <|endoftext|> ", "a<|endoftext|>b"]
    got = {r.doc_id: r for r in t.count_tokens(docs(spark, texts), NAME).collect()}
    for i, text in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(text or "", add_special_tokens=False)), repr(text)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(t, "MEMORY_PIECES", 50)
    memory = {}
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)]
    for i in range(0, 40, 4):
        got = t.lengths(library, memory, texts[i : i + 4])
        assert got == [len(library.encode(x, add_special_tokens=False)) for x in texts[i : i + 4]]
        assert len(memory) <= 100
    assert t.lengths(library, memory, texts) == [len(library.encode(x, add_special_tokens=False)) for x in texts]


def test_batches_are_even_in_bytes():
    batches = list(t.by_bytes(["a" * 10] * 20 + ["b" * 100], 50))
    assert [len(b) for b in batches] == [5, 5, 5, 5, 1]


def test_repeats_nulls_and_empty_tables(spark):
    df = odd_columns(docs(spark, [(1, "a b"), (1, "a b"), (None, None)]), "n_tokens", "key")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in t.count_tokens(df, NAME).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert t.count_tokens(df.where("doc_id = 9"), NAME).count() == 0
