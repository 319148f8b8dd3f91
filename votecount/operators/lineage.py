"""Cutting a plan at a reliable copy in the folder shared by the cluster."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only a local session that names none gets its warehouse's."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a checkpoint that survives lost executors.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark remove it once unused.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, copies: list[str] | None = None) -> DataFrame:
    """The same rows, read back from a columnar copy in the shared folder.

    A reader of a few columns reads those only, which a checkpoint of whole rows does not allow.
    ``copies`` collects the paths; ``forget`` removes them once the results are written.
    """
    path = shared_path(df.sparkSession, "copia")
    if copies is not None:
        copies.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, copies: list[str]) -> None:
    """Remove copies that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in copies:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
