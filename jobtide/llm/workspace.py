"""Intermediate tables of one operator call, on the storage that all executors share."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

FILES_PER_CORE = 4
_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers find it wherever the
    driver was started.  It travels as a zip file (under 1 MB) through shared storage."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    path = f"{ensure_checkpoint_dir(spark)}/{_PACKAGE.name}-{uuid.uuid4().hex}/{_PACKAGE.name}.zip"
    files, target = _hadoop(spark, path)
    out = files.create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    files.deleteOnExit(target.getParent())
    context.addPyFile(target.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())
    _shipped.add(context.applicationId)


class Workspace:
    """A folder below ``spark.checkpoint.dir`` for one call.

    ``settle`` writes a frame as Parquet and reads it back: the work is done once, the rows stay fixed,
    and a lost executor loses none of them.  ``finish`` settles the result beside the folder and deletes
    the folder, so that a call leaves its result and nothing else.  Where the result is the input itself
    but for what one small table says, ``keep_only`` leaves that table and the result is joined when read.
    What a call leaves is deleted when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        ship(spark)
        self._own(self.folder)

    def _own(self, folder: str) -> None:
        files, path = _hadoop(self.spark, folder)
        files.mkdirs(path)  # only what is there can be marked
        files.deleteOnExit(path)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, f"{self.folder}/{name}")

    def settle_narrow(self, df: DataFrame, name: str) -> DataFrame:
        """For the many narrow tables of a loop: a few files per core, as opening more takes longer than reading them."""
        return self.settle(df.coalesce(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism), name)

    def drop(self, name: str = "") -> None:
        files, path = _hadoop(self.spark, f"{self.folder}/{name}" if name else self.folder)
        files.delete(path, True)

    def keep_only(self, name: str) -> None:
        files, path = _hadoop(self.spark, self.folder)
        for status in files.listStatus(path):
            if status.getPath().getName() != name:
                self.drop(status.getPath().getName())

    def finish(self, df: DataFrame) -> DataFrame:
        self._own(f"{self.folder}-result")
        result = self._write(df, f"{self.folder}-result")
        self.drop()
        return result
