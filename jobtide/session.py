"""Session settings the operators rely on, and where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NullType

# Adaptive execution does the runtime part of the scale work: it coalesces
# small shuffle partitions, splits skewed join partitions, and turns a shuffle
# join into a broadcast join only after it has seen the real size of a side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of more than 8,000 bytes; Spark runs such a stage faster expression by
    # expression than as one method that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Landed pages are large rows; keep the batches that go to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def local_session(cores: str | int = "*", app: str = "jobtide", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **extra,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="jobtide-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _shared_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path on shared storage for a new table or folder; what is written there is deleted when the session's process ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, folder = _shared_path(spark, path)
    files.mkdirs(folder)  # only what is there can be marked
    files.deleteOnExit(folder)
    return f"{path}/data"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder from ``shared_folder`` now."""
    files, folder = _shared_path(spark, path)
    files.delete(folder.getParent(), True)


def _copied(df: DataFrame, path: str) -> DataFrame:
    # A column without a type cannot be stored, and need not be.
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]
    kept = df.drop(*void)
    kept.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])


def settled(df: DataFrame) -> DataFrame:
    """The frame's rows, worked out once and kept as Parquet on shared storage until the session's process ends.

    For results that several plans read.  The rows stay fixed, plans read only the columns they
    need, and the copy outlives the executors that computed it.
    """
    return _copied(df, shared_folder(df.sparkSession, "settled"))


@contextmanager
def settled_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """The same, deleted at the end of the block: for rows that are read inside it only."""
    path = shared_folder(df.sparkSession, "settled")
    try:
        yield _copied(df, path)
    finally:
        delete_folder(df.sparkSession, path)
