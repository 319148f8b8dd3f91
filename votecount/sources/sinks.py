"""Writers: insert-if-absent, event and log appends, snapshot swap, seeding."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount.operators.groups import first_wins
from votecount.operators.machine import storable_sheets
from votecount.operators.official import to_official_tables


def insert_if_absent(
    new: DataFrame, existing: DataFrame | None, key: str, order: Column
) -> DataFrame:
    """Rows of ``new`` to append: the first per key, and only keys not stored yet."""
    fresh = first_wins(new, key, order)
    if existing is None:
        return fresh
    return fresh.join(existing.select(key), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def append_sheets(sheets: DataFrame, path: str) -> None:
    """Store sheets whose id and source hash are both new, in the order of their arrival."""
    stored = read_store(sheets.sparkSession, path)
    storable_sheets(sheets, stored).select(sheets.columns).write.mode("append").parquet(path)


def append_sms(register: DataFrame, path: str, order: Column) -> None:
    """Store register rows; a second row for the same text is lost silently."""
    stored = read_store(register.sparkSession, path)
    insert_if_absent(register, stored, "hash_mensaje", order).write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Add to the event log; a numbered batch has a folder of its own and may be written again."""
    _append(events, path, batch)


def append_inconsistencies(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add to the inconsistency log, as ``append_events`` does."""
    _append(rows, path, batch)


def _append(rows: DataFrame, path: str, batch: int | None) -> None:
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/lote={batch}")


def write_snapshot(snapshot: DataFrame, root: str, version: int) -> str:
    """Write a version (the batch id) beside the old ones; readers take the newest complete one.

    A version only counts once Spark's _SUCCESS file is in it, so a reader never sees a
    half-written snapshot and a failed writer changes nothing. Writing one again replaces it.
    """
    stamped = snapshot.withColumn("ultima_actualizacion", F.current_timestamp())
    path = f"{root}/version={version}"
    stamped.write.mode("overwrite").parquet(path)
    return path


def _names(spark: SparkSession, root: str, start: str) -> list[str]:
    """Names of the folders in a folder that begin so."""
    if not exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith(start)]


def _versions(spark: SparkSession, root: str) -> list[int]:
    numbers = [int(n.split("=")[1]) for n in _names(spark, root, "version=")]
    return [n for n in numbers if exists(spark, f"{root}/version={n}/_SUCCESS")]


def next_version(spark: SparkSession, root: str) -> int:
    """A number above those in use: several channels refresh one snapshot."""
    return max(_versions(spark, root), default=-1) + 1


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    done = _versions(spark, root)
    return spark.read.parquet(f"{root}/version={max(done)}") if done else None


def write_official(valid: DataFrame, sheets_path: str, votes_path: str, batch: str) -> None:
    """Sheet rows and vote rows of one batch, each under the batch's own folder.

    Writing the same batch again replaces it. Votes go first, and a batch counts once both its
    folders are complete (``read_official``): a failed second write leaves nothing to be seen.
    """
    sheets, votes = to_official_tables(valid)
    for rows, path in ((votes, votes_path), (sheets, sheets_path)):
        rows.write.mode("overwrite").parquet(f"{path}/lote={batch}")


def read_official(spark: SparkSession, sheets_path: str, votes_path: str) -> tuple[DataFrame, DataFrame] | None:
    """Sheets and votes of the batches that have both."""
    names = [set(_names(spark, p, "lote=")) for p in (sheets_path, votes_path)]
    done = [n for n in sorted(names[0] & names[1]) if all(exists(spark, f"{p}/{n}/_SUCCESS") for p in (sheets_path, votes_path))]
    if not done:
        return None
    read = lambda p: spark.read.option("basePath", p).parquet(*[f"{p}/{n}" for n in done])
    return read(sheets_path), read(votes_path)


def truncate_official(spark: SparkSession, sheets_path: str, votes_path: str) -> None:
    """Empty both tables but keep their layout; votes first, as they depend on sheets."""
    for path in (votes_path, sheets_path):
        schema = spark.read.parquet(path).drop("lote").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def seed_if_empty(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def migrate(df: DataFrame, path: str) -> None:
    """Copy a store without its internal id, unless the target already exists."""
    seed_if_empty(df.drop("_id"), path)
