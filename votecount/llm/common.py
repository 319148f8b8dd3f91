"""What several operators share: the folder all executors see, saved tables, fresh join keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    On a cluster that has it elsewhere (installed, or sent with the job) this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``. Only a local session that names none gets a folder of
    its own; on a cluster that would be one machine's disk, so there it is an error. The folder
    holds tables that a returned DataFrame still reads, and may go once its result is written.
    """
    importable(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="votecount-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Shuffle files go when the execution that wrote them ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The rows of ``df`` written once as a table and read back; whole texts are worth a tighter ``compression``.

    The shuffles of the write are of no use once the table stands, so their files go with it.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of a job's own folder that nothing to come will read."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def fresh(key: Column) -> Column:
    """The key in a form the planner takes for a new one.

    A join on it sorts both sides anew, so that a hot key's partition can be split at run time;
    a side that an aggregation has already placed by the plain key could not be split.
    """
    return F.concat(F.lit("k"), key.cast("string"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_long(key: Column) -> Column:
    """``fresh`` for a number."""
    return key.cast("bigint").bitwiseXOR(F.lit(0x5DEECE66D))
