"""Delimited files whose quoted values hold line breaks, read by many tasks at once.

Where such a file is cut, nothing tells whether the cut lies inside quotes. So the file is read
twice as lines. The first time every split works out how it ends if it begins outside of quotes and
how if it begins inside; those answers chain, and a fold over the few rows per file (one for each
split) tells how every split really begins. The second time each split cuts its own records, and
only what crosses a cut is put together again, by the split in which it began (in a scan of its own,
run only if something does).

The order of lines within a split is that of the scan; nothing is sorted and no line is shuffled
(unless more splits begin inside quotes than can be sent to all tasks). Lines are judged one by one
only where they hold a quote.
"""

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits that begin inside quotes, up to which they are sent to every task.
SENT = 100_000
#: A quote within quotes is doubled; a backslash is a letter like others.
OPTIONS = {"mode": "PERMISSIVE", "escape": '"'}
_SPLITS = "f string, b bigint, outside boolean, inside boolean, breaks boolean, head string"
_BEGINS = "f string, b bigint, origin bigint"
_RECORDS = "f string, b bigint, origin bigint, record string"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _as_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def inside_after(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the end of a line lies inside quotes; a quote opens a value only where the value begins."""
    i = 0
    while True:
        if inside:
            i = line.find('"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] == '"':
                i += 2
                continue
            inside = False
        elif line[i : i + 1] == '"':
            inside, i = True, i + 1
            continue
        i = line.find(delimiter, i) + 1
        if not i:
            return False


def lines_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", r"\r\z", "").alias("line"),
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Pieces of a batch that come from one split each."""
    f, b = batch.column("f").to_pylist(), batch.column("b").to_pylist()
    start = 0
    for i in range(1, len(b) + 1):
        if i == len(b) or b[i] != b[start] or f[i] != f[start]:
            yield f[start], b[start], batch.slice(start, i - start)
            start = i


def _quoted(lines: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(lines, '"')).as_py())


def scan(lines: DataFrame) -> DataFrame:
    """One row per split: how it ends from either beginning, and a file's first line in its first one.

    ``breaks`` tells whether a record ends in it even if it begins inside quotes.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []
        for batch in batches:
            for f, b, piece in _runs(batch):
                if at[:2] != [f, b]:
                    if at:
                        yield _row(_SPLITS, at)
                    at = [f, b, False, True, False, piece.column("line")[0].as_py() if b == 0 else None]
                if not _quoted(piece.column("line")):
                    continue
                for line in piece.column("line").to_pylist():
                    if '"' in line:
                        at[2] = inside_after(line, at[2])
                        at[3] = inside_after(line, at[3])
                    at[4] |= not at[3]
        if at:
            yield _row(_SPLITS, at)

    return lines.mapInArrow(judge, _SPLITS)


def _row(ddl: str, values: list) -> pa.RecordBatch:
    schema = _as_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema, strict=True)], schema=schema)


def begins(splits: DataFrame) -> DataFrame:
    """The splits that begin inside quotes, each with the split in which that record began."""

    def fold(own: pa.Table) -> pa.Table:
        out, inside, origin = [], False, None
        for s in sorted(own.to_pylist(), key=lambda s: s["b"]):
            if inside:
                out.append({"f": s["f"], "b": s["b"], "origin": origin})
            if not inside or s["breaks"]:
                origin = s["b"]
            inside = s["inside"] if inside else s["outside"]
        return pa.Table.from_pylist(out, _as_schema(_BEGINS))

    return splits.drop("head").groupBy("f").applyInArrow(fold, _BEGINS)


def records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(f, record): every record but the first of a file, which is its header, with line breaks kept."""
    crossed = starts.count()
    few = crossed <= SENT
    known = F.broadcast(starts) if few else starts
    lines = lines.join(known, ["f", "b"], "left").select("line", "f", "b", "i", "origin")
    if not few:
        lines = lines.repartition("f", "b").sortWithinPartitions("i")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _as_schema(_RECORDS)
        split, open_, origin, header = None, [], None, False

        def rest() -> Iterator[pa.RecordBatch]:
            if open_:  # cut off by the end of the split
                yield _row(_RECORDS, [*split, split[1] if origin is None else origin, "\n".join(open_)])

        for batch in batches:
            for f, b, piece in _runs(batch):
                if split != (f, b):
                    yield from rest()
                    split, open_, origin, header = (f, b), [], piece.column("origin")[0].as_py(), b == 0
                    inside = origin is not None
                lines_ = piece.column("line")
                if not inside and not header and not open_ and not _quoted(lines_):
                    n = piece.num_rows
                    yield pa.RecordBatch.from_arrays([piece.column("f"), piece.column("b"), pa.nulls(n, pa.int64()), lines_], schema=schema)
                    continue
                done: list[tuple[int | None, str]] = []
                for line in lines_.to_pylist():
                    open_.append(line)
                    if '"' in line:
                        inside = inside_after(line, inside)
                    if not inside:
                        if not header:
                            done.append((origin, "\n".join(open_)))
                        open_, origin, header = [], None, False
                if done:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(done)), pa.array([b] * len(done), pa.int64()),
                         pa.array([o for o, _ in done], pa.int64()), pa.array([r for _, r in done])], schema=schema)
        yield from rest()

    cut_up = lines.mapInArrow(assemble, _RECORDS)
    whole = cut_up.where((F.col("record") != "") & F.col("origin").isNull()).select("f", "record")
    if not crossed:
        return whole
    pieces = F.array_sort(F.collect_list(F.struct("b", "record")))
    # The pieces of one record, which has to be one row in the end anyway.
    joined = cut_up.where(F.col("origin").isNotNull()).groupBy("f", "origin").agg(pieces.alias("p"))
    joined = joined.select("f", F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined)


def columns_of(header: str) -> list[str]:
    """Names in a header line; nameless and repeated ones are told apart by their place."""
    names = next(csv.reader(io.StringIO(header.removeprefix("﻿"))), [])
    return [f"_c{i}" if not n else f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def parsed(rows: DataFrame, header: str) -> DataFrame:
    """Text columns of records that follow one header."""
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in columns_of(header))
    return rows.select(F.from_csv("record", names, OPTIONS).alias("r")).select("r.*")
