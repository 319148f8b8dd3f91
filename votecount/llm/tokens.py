"""Token counts by a public tokenizer, in Arrow functions that return lengths only.

Texts are split at safe boundaries: before a run of blanks that follows a printable ASCII
character. The byte-level pre-tokenizer never reaches across such a place (its tokens may begin
with a blank but none goes on past a printable character into one), so the lengths of the pieces
add up to the length of the text however long it is. The pieces a worker has not met yet are
encoded in batches balanced by bytes, and their lengths are kept in a memory of bounded size.

Edge cases: a null text counts as empty (no bytes, no tokens); a text with white space beyond
ASCII is encoded whole, because its runs could mix with blanks; special strings inside a text are
treated as the library does by default; repeated rows and null keys give one row each; an empty
table gives an empty result. There is no shuffle: a scan's partitions are even in bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes handed to the encoder at once, and pieces whose lengths a worker remembers.
BATCH_BYTES = 1 << 20
MEMORY_PIECES = 500_000

_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space other than space, tab, line feed and carriage return.
_WIDE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LOADED: dict[str, tuple] = {}


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The tokenizer of a file, loaded once per worker; a bare name means a public one."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path if os.path.sep in path else vocabulary(path)), {})
    return _LOADED[path]


def by_bytes(items: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The items in batches of about ``limit`` bytes; a longer item is a batch of its own."""
    batch: list[str] = []
    size = 0
    for x in items:
        if batch and size + len(x) > limit:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += len(x)
    if batch:
        yield batch


def pieces_of(text: str) -> list[str]:
    return [text] if _WIDE.search(text) else _PIECE.findall(text)


def lengths(tokenizer, memory: dict[str, int], texts: list[str]) -> list[int]:
    """Tokens of each text. ``memory`` holds lengths of pieces met before."""
    split = [pieces_of(t) for t in texts]
    new = list({p for ps in split for p in ps if p not in memory})
    found = {}
    for batch in by_bytes(new):
        for piece, e in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            found[piece] = len(e)
    if len(memory) + len(found) > MEMORY_PIECES:
        # Start the memory anew; what this batch still needs of it is kept.
        found |= {p: memory[p] for ps in split for p in ps if p in memory}
        memory.clear()
    get = (memory | found if len(found) > MEMORY_PIECES else memory).__getitem__
    if len(found) <= MEMORY_PIECES:
        memory.update(found)
    return [sum(map(get, ps)) for ps in split]


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``limit`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: the key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, memory = encoder(path)
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                n = lengths(tokenizer, memory, batch.column("text").to_pylist())
                size = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), size, pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"]
                )

    found = rows.mapInArrow(counted, f"key {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return found.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
