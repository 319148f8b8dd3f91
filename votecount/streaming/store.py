"""The quick-count store that the streams write and look up: lots, merged runs, running totals.

Every micro-batch of a channel writes its rows into folders of its own, named after channel and
batch, and reads only what was there before it; run again after a failure it overwrites its own
folders, so every message and file takes effect once. Channels number their batches by themselves.

* **Look-ups** go by a prefix of a key's hash: sheets by id, the register by text, and an index from
  source hash to sheet id beside the sheets, so that a batch finds earlier sheets by id *and* by
  hash and opens only the folders of prefixes that it holds.
* **Lots are merged**: when the number of batches reaches a multiple of ``MERGE``, of its square and so
  on, the last so many lots become one run. A row is written again once per power, and a reader
  opens at most ``MERGE`` - 1 folders per power. Parts of a run go once a later batch has begun.
* **Totals** are kept running: a batch adds its counts to one earlier total and so reads as much after
  a million batches as after one. A changed sheet counts once off its old group and once onto its
  new one.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount import constants as K
from votecount.operators.machine import _PREVIOUS
from votecount.sources.sinks import append_events, append_inconsistencies, exists

MERGE = 16
#: Channels of a store. Corrections are newer versions of sheets that others have written.
SMS, UPLOAD, CORRECTION = K.SMS, "UPLOAD", "CORRECCION"


@dataclass(frozen=True)
class Store:
    """Folders of one quick-count store."""

    root: str

    @property
    def register(self) -> str:
        return f"{self.root}/sms_register"

    @property
    def sheets(self) -> str:
        return f"{self.root}/sheets"

    @property
    def hashes(self) -> str:
        return f"{self.root}/sheets_by_hash"

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def inconsistencies(self) -> str:
        return f"{self.root}/inconsistencies"

    @property
    def totals(self) -> str:
        return f"{self.root}/totals"

    @property
    def snapshot(self) -> str:
        return f"{self.root}/snapshot"

    # --- reading -------------------------------------------------------------------

    def read(
        self,
        spark: SparkSession,
        path: str,
        before: int | None = None,
        prefixes: list[str] | None = None,
        channel: str = SMS,
    ) -> DataFrame | None:
        """A stored table of all channels, optionally as it was before a batch of ``channel``."""
        lots, runs = [], []
        for own in _children(spark, path, "canal="):
            upto = before if own == channel else None
            for first, last in _cover(spark, f"{path}/canal={own}", f"{path}-runs/canal={own}", upto):
                if first == last:
                    lots.append(f"{path}/canal={own}/lote={last}")
                else:
                    runs.append(f"{path}-runs/canal={own}/tramo={first}-{last}")
        frames = []
        for base, folders in ((path, lots), (f"{path}-runs", runs)):
            if folders := [f for f in folders if _has_rows(spark, f)]:
                frames.append(spark.read.option("basePath", base).parquet(*folders).drop("tramo"))
        if not frames:
            return None
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return df if prefixes is None else df.where(F.col("prefijo").isin(prefixes))

    def current_sheets(self, spark: SparkSession, ids: DataFrame | None = None, before: int | None = None, channel: str = SMS) -> DataFrame | None:
        """The newest version of every sheet, or of those with ids in ``ids`` (acta_id)."""
        prefixes = prefixes_of(ids, F.col("acta_id")) if ids is not None else None
        rows = self.read(spark, self.sheets, before, prefixes, channel)
        if rows is None:
            return None
        if ids is not None:
            rows = rows.join(ids.select("acta_id").distinct(), "acta_id", "left_semi")
        if CORRECTION in _children(spark, self.sheets, "canal="):
            newest = rows.groupBy("acta_id").agg(F.max("version").alias("version"))
            rows = rows.join(newest, ["acta_id", "version"], "left_semi")
        return rows.drop("lote", "prefijo", "canal")

    def known(self, files: DataFrame, before: int, channel: str) -> DataFrame | None:
        """Sheets stored before that share an id or a source hash with the files."""
        spark = files.sparkSession
        ids = files.select("acta_id")
        hashes = files.select("hash_origen").where(F.col("hash_origen").isNotNull()).distinct()
        index = self.read(spark, self.hashes, before, prefixes_of(hashes, F.col("hash_origen")), channel)
        if index is not None:
            ids = ids.unionByName(index.join(hashes, "hash_origen", "left_semi").select("acta_id"))
        found = self.current_sheets(spark, ids.distinct(), before, channel)
        return None if found is None else found.select("acta_id", *_PREVIOUS)

    # --- writing -------------------------------------------------------------------

    def write(self, df: DataFrame, path: str, batch: int, channel: str = SMS, key: str | None = None) -> None:
        """The rows of one batch, in place of what an earlier attempt at it wrote."""
        folder = f"{path}/canal={channel}"
        if path == self.events:
            append_events(df, folder, batch)
        elif path == self.inconsistencies:
            append_inconsistencies(df, folder, batch)
        elif key is None:
            df.write.mode("overwrite").parquet(f"{folder}/lote={batch}")
        else:
            placed = df.withColumn("prefijo", F.coalesce(prefix(F.col(key)), F.lit("p")))
            placed.write.partitionBy("prefijo").mode("overwrite").parquet(f"{folder}/lote={batch}")

    def write_sheets(self, sheets: DataFrame, batch: int, channel: str, version: int = 0) -> None:
        """Sheets by id, after the index that finds them by hash: an entry without a sheet finds nothing."""
        index = sheets.select("hash_origen", "acta_id").where(F.col("hash_origen").isNotNull())
        self.write(index, self.hashes, batch, channel, "hash_origen")
        self.write(sheets.withColumn("version", F.lit(version)), self.sheets, batch, channel, "acta_id")

    def add_to_totals(self, delta: DataFrame, batch: int, channel: str) -> None:
        """The channel's counts up to this batch: those up to an earlier one, and what it adds."""
        spark = delta.sparkSession
        folder = f"{self.totals}/canal={channel}"
        earlier = [n for n in _lots(spark, folder) if n < batch]
        rows = delta.select("grupo", "clave", "cantidad")
        if earlier:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/lote={max(earlier)}"))
        total = rows.groupBy("grupo", "clave").agg(F.sum("cantidad").alias("cantidad"))
        # A handful of groups; a total that a replay of this batch needs stays.
        total.coalesce(1).write.mode("overwrite").parquet(f"{folder}/lote={batch}")
        for n in sorted(earlier)[:-1]:
            _remove(spark, f"{folder}/lote={n}")

    def total(self, spark: SparkSession) -> DataFrame | None:
        """Counts over all channels (grupo, clave, cantidad)."""
        newest = []
        for channel in _children(spark, self.totals, "canal="):
            if lots := _lots(spark, f"{self.totals}/canal={channel}"):
                newest.append(f"{self.totals}/canal={channel}/lote={max(lots)}")
        if not newest:
            return None
        return spark.read.parquet(*newest).groupBy("grupo", "clave").agg(F.sum("cantidad").alias("cantidad"))

    def merge(self, spark: SparkSession, batch: int, channel: str) -> None:
        """Merge the lots that this batch completes a power of ``MERGE`` of, and drop merged ones."""
        for path in (self.register, self.sheets, self.hashes, self.events, self.inconsistencies):
            lots, runs = f"{path}/canal={channel}", f"{path}-runs/canal={channel}"
            width = MERGE
            while (batch + 1) % width == 0:
                first = batch + 1 - width
                parts = _cover(spark, lots, runs, batch + 1, first, skip=(first, batch))
                folders = [(lots if a == b else runs) + (f"/lote={b}" if a == b else f"/tramo={a}-{b}") for a, b in parts]
                frames = [_with_lot(spark, f) for f in folders if _has_rows(spark, f)]
                if frames:
                    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
                    target = f"{runs}/tramo={first}-{batch}"
                    if "prefijo" in rows.columns:
                        rows.repartition("prefijo").write.partitionBy("prefijo").mode("overwrite").parquet(target)
                    else:
                        rows.write.mode("overwrite").parquet(target)
                width *= MERGE
            done = [r for r in _runs(spark, runs) if r[1] < batch]
            for a, b in done:
                for n in _lots(spark, lots):
                    if a <= n <= b:
                        _remove(spark, f"{lots}/lote={n}")
                for c, d in _runs(spark, runs):
                    if (c, d) != (a, b) and a <= c and d <= b:
                        _remove(spark, f"{runs}/tramo={c}-{d}")


def prefix(key: Column) -> Column:
    """Which of 256 folders a key belongs to; a letter in front keeps it a text."""
    return F.concat(F.lit("p"), F.substring(F.sha2(key, 256), 1, 2))


def prefixes_of(df: DataFrame, key: Column) -> list[str]:
    """The prefixes that occur, 256 at most."""
    found = df.where(key.isNotNull()).select(prefix(key).alias("p")).distinct()
    return sorted(r.p for r in found.collect())


def _with_lot(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if "lote" in rows.columns else rows.withColumn("lote", F.lit(int(folder.rsplit("=", 1)[1])))


# --- folders ----------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str, start: str) -> list[str]:
    if not exists(spark, path):
        return []
    folder, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removeprefix(start) for n in names if n.startswith(start))


def _lots(spark: SparkSession, folder: str) -> list[int]:
    """Complete lots only; one without its mark is still being written."""
    return sorted(int(n) for n in _children(spark, folder, "lote=") if exists(spark, f"{folder}/lote={n}/_SUCCESS"))


def _runs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    found = [n for n in _children(spark, folder, "tramo=") if exists(spark, f"{folder}/tramo={n}/_SUCCESS")]
    return sorted((int(a), int(b)) for a, b in (n.split("-") for n in found))


def _cover(
    spark: SparkSession, lots: str, runs: str, before: int | None, least: int = 0, skip: tuple[int, int] | None = None
) -> list[tuple[int, int]]:
    """The widest runs, and single lots, that hold every lot from ``least`` on and below ``before``, once."""
    single = {n for n in _lots(spark, lots) if (before is None or n < before) and n >= least}
    merged = [r for r in _runs(spark, runs) if (before is None or r[1] < before) and r[0] >= least and r != skip]
    out: list[tuple[int, int]] = []
    at = max([*single, *(r[1] for r in merged)], default=-1)
    while at >= least:
        wide = min((r for r in merged if r[1] == at), default=None)
        if wide:
            out.append(wide)
            at = wide[0] - 1
        else:
            if at in single:
                out.append((at, at))
            at -= 1
    return out[::-1]


def _has_rows(spark: SparkSession, path: str) -> bool:
    folder, fs = _path(spark, path)
    files = fs.listFiles(folder, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def _remove(spark: SparkSession, path: str) -> None:
    folder, fs = _path(spark, path)
    fs.delete(folder, True)
