"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps a fixed number of open windows. A document's full windows are cut off first;
its rest goes into the window where it fits best. When none fits, the fullest is emitted: it is
first topped up with the head of that rest if its gap is worth a cut, and the remainder is placed
again. At the end of a partition the emptiest windows are cut up to fill the fullest, and the one
left over by each partition meets those of others in a second, small round that moves whole
windows, so few sequences stay half empty.

Memory is bounded by the open windows and one Arrow batch. A lost task is run again on the same
rows and gives the same sequences. Ids come from the library; what a white-space separated chunk
encodes to is remembered by the worker (a chunk is independent of its neighbours, since the
normalizer and pre-tokenizer drop white space), in a memory of bounded size.

Edge cases: a null text counts as empty and gives the end id alone; a very long text is cut into
full sequences; repeated rows and null keys are packed like any others; an empty table gives no
pieces. Sequence ids are unique but not gapless.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import saved, shared_folder
from votecount.llm.tokens import by_bytes, encoder, slices_by_bytes

CAPACITY = 2048
END_ID = 1
OPEN_WINDOWS = 64
#: The least gap that is filled by cutting a document.
LEAST_CUT = 16
#: Partitions whose leftovers are merged by one task.
MERGED_PARTITIONS = 64
MEMORY_CHUNKS = 400_000

_CHUNK = re.compile(r"[^ \t\n\r]+")
#: Letters on which Python and the library agree about case and composition, then marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%&$#]*)\Z")
_STEMS: dict[str, dict[str, bytes]] = {}
#: The byte-level alphabet: bytes that print stand for themselves, the others follow from 256.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}


def _encode_new(tokenizer, chunks: list[str], stems: dict[str, bytes]) -> dict[str, bytes]:
    """Ids of each chunk as little-endian bytes; letters and marks are encoded apart, once each."""
    model, out, whole = tokenizer.model, {}, []
    for c in chunks:
        m = _PLAIN.match(c)
        if not m:
            whole.append(c)
            continue
        stem, marks = m[1].lower(), m[2]
        if stem not in stems:
            # A run of such letters is one pre-token, so it can go to the model as it is.
            spelled = stem.encode().decode("latin-1").translate(_ALPHABET)
            stems[stem] = np.array([t.id for t in model.tokenize(spelled)], "<u4").tobytes()
        if marks and marks not in stems:
            stems[marks] = np.array(tokenizer.encode(marks, add_special_tokens=False).ids, "<u4").tobytes()
        out[c] = stems[stem] + stems[marks] if marks else stems[stem]
    for batch in by_bytes(whole):
        for c, e in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            out[c] = np.array(e.ids, "<u4").tobytes()
    return out


def encode_texts(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, then the end id."""
    tokenizer, memory = encoder(path)
    stems = _STEMS.setdefault(path, {})
    split = [_CHUNK.findall(t) for t in texts]
    if len(memory) > MEMORY_CHUNKS:
        memory.clear()
    if len(stems) > MEMORY_CHUNKS:
        stems.clear()
    memory.update(_encode_new(tokenizer, list({c for cs in split for c in cs if c not in memory}), stems))
    end = np.array([END_ID], "<u4").tobytes()
    for cs in split:
        yield np.frombuffer(b"".join(map(memory.__getitem__, cs)) + end, "<u4")


class Windows:
    """A fixed number of open windows; ``put`` and ``close`` emit full or fullest ones.

    A piece is (document, start, ids, document tokens). Windows are kept in the order of their
    gaps, so that the best fit and the fullest are found by bisection.
    """

    def __init__(self, emit, capacity: int = CAPACITY, n: int = OPEN_WINDOWS):
        self.emit, self.capacity, self.n = emit, capacity, n
        self.gaps: list[tuple[int, int]] = []  # (gap, number of the window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def _add(self, at: int | None, piece: tuple) -> None:
        """Into the window at this place of the order, or into a new one."""
        if at is None:
            gap, number = self.capacity, self.made
            self.held[number] = []
            self.made += 1
        else:
            gap, number = self.gaps.pop(at)
        self.held[number].append(piece)
        gap -= len(piece[2])
        if gap:
            insort(self.gaps, (gap, number))
        else:
            self.emit(self.held.pop(number))

    def put(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0

        def piece(n: int) -> tuple:
            return doc, start, ids[start : start + n], total

        while total - start >= self.capacity:
            self.emit([piece(self.capacity)])
            start += self.capacity
        while start < total:
            rest = total - start
            at = bisect_left(self.gaps, (rest, -1))
            if at < len(self.gaps):
                self._add(at, piece(rest))
                return
            if len(self.gaps) < self.n:
                self._add(None, piece(rest))
                return
            gap = self.gaps[0][0]
            if gap >= LEAST_CUT:
                self._add(0, piece(gap))
                start += gap
            else:
                self.emit(self.held.pop(self.gaps.pop(0)[1]))

    def close(self) -> list[tuple]:
        """Fill the fullest windows from the emptiest; return the one that stays open."""
        order = [self.held[number] for _, number in self.gaps]
        self.gaps, self.held = [], {}
        while order:
            window = order.pop(0)
            gap = self.capacity - sum(len(p[2]) for p in window)
            while order and gap >= LEAST_CUT:
                doc, start, ids, total = order[-1].pop()
                window.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    order[-1].append((doc, start + gap, ids[gap:], total))
                if not order[-1]:
                    order.pop()
                gap -= len(window[-1][2])
            if gap >= LEAST_CUT:
                return window
            self.emit(window)
        return []


def merge(windows: list[tuple[int, object]], capacity: int = CAPACITY) -> Iterator[list[object]]:
    """Whole windows put together, largest first, each where it fits best. (fill, content) each."""
    gaps: list[tuple[int, int]] = []
    groups: list[list[object]] = []
    for fill, content in sorted(windows, key=lambda w: -w[0]):
        at = bisect_left(gaps, (fill, -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        else:
            gap, number = capacity, len(groups)
            groups.append([])
        groups[number].append(content)
        insort(gaps, (gap - fill, number))
    yield from groups


_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, window bigint, fill bigint, place bigint"


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base = TaskContext.get().partitionId() << 32
        made = 0

        def emit(pieces: list[tuple], open_end: bool = False) -> None:
            nonlocal made
            fill, place = sum(len(p[2]) for p in pieces), 0
            for doc, start, ids, total in pieces:
                crc = zlib.crc32(ids.tobytes())
                # A negative fill marks a window that is still open at the end.
                out.append((doc, start, len(ids), crc, total, base + made, -fill if open_end else fill, place))
                place += len(ids)
            made += 1

        def table() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out, strict=True)) or [[]] * 8
            names = ["key", *(f.split(" ")[0] for f in _PIECES.split(", "))]
            out = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names
            )

        windows, key_type = Windows(emit, capacity), None
        for whole in batches:
            key_type = whole.column("key").type
            for batch in slices_by_bytes(whole, "text"):
                for doc, ids in zip(
                    batch.column("key").to_pylist(), encode_texts(path, batch.column("text").to_pylist()), strict=True
                ):
                    windows.put(doc, ids)
                if out:
                    yield table()
        if left := windows.close():
            emit(left, open_end=True)
        if out:
            yield table()

    pieces = saved(rows.mapInArrow(online, f"key {kind}, {_PIECES}"), f"{shared_folder(docs.sparkSession)}/pieces")
    done = pieces.where("fill > 0").select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.col("window").alias("sequence_id"), F.col("place").alias("offset"),
    )
    return done.unionByName(_leftovers(pieces.where("fill < 0"), key, kind, capacity))


def _leftovers(pieces: DataFrame, key: str, kind: str, capacity: int) -> DataFrame:
    """The windows left open by the partitions, merged by groups of partitions."""

    def merged(found: pa.Table) -> pa.Table:
        rows = found.sort_by([("window", "ascending"), ("place", "ascending")]).to_pylist()
        windows: dict[int, list[dict]] = {}
        for r in rows:
            windows.setdefault(r["window"], []).append(r)
        base = (1 << 62) + (rows[0]["group"] << 32)
        for n, ws in enumerate(merge([(-w[0]["fill"], w) for w in windows.values()], capacity)):
            place = 0
            for r in (r for w in ws for r in w):
                r["sequence_id"], r["offset"] = base + n, place
                place += r["length"]
        columns = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        types = [found.schema.field("key").type, *[pa.int64()] * 6]
        return pa.Table.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)], [key, *columns[1:]]
        )

    group = F.expr(f"(window >> 32) div {MERGED_PARTITIONS}")
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return pieces.withColumn("group", group).groupBy("group").applyInArrow(merged, schema)
