"""Files in, declared frames out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import repair_invalid_bytes
from ..functions.dates import archive_date

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "NA"}
ROW_INDEX_COLUMN = "X"


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled and missing values written as NA.

    Quoted values may hold line breaks, which makes each file one task; say ``line_breaks=False`` of files
    known to have none, and large ones are cut into many.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS | {"multiLine": str(line_breaks).lower()}).csv(path)


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (column ``value``) with its bytes untouched; the CSV and
    JSON readers would replace bytes that are not UTF-8 for good."""
    return spark.read.text(path)


def parse_csv_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Repair the bytes first, parse afterwards.  For files without quoted line breaks."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"escape": '"', "nullValue": "NA"}
    parsed = lines.select(F.from_csv(repair_invalid_bytes(column), F.lit(ddl), options).alias("r")).select("r.*")
    return parsed.filter(~F.coalesce(F.col(schema.names[0]).cast("string") == schema.names[0], F.lit(False)))


def _headers(spark: SparkSession, path: str, glob: str) -> dict[str, list[str]]:
    """{header line: files}.

    In a session of its own, in which every file is one task and a task is asked for one line at a time, each file is
    opened, its first line read and the rest left alone.  The driver sees one short row per file, which the
    file listing already gave it.
    """
    alone = spark.newSession()
    whole = str(1 << 40)  # larger than any file: a file is one split, and no task takes two
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        alone.conf.set(key, whole)
    alone.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = alone.read.option("pathGlobFilter", glob).text(path).select("value", "_metadata.file_path")

    def first(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from islice((f for f in frames if f.num_rows), 1)

    found = defaultdict(list)
    for row in lines.mapInArrow(first, "value string, file_path string").collect():
        found[row["value"]].append(unquote(row["file_path"]))  # it comes as an escaped URI
    return found


def read_snapshot_csvs(spark: SparkSession, path: str, glob: str = "*.csv", date: str = "Archive_Date") -> DataFrame:
    """All dated snapshot files as one frame of text columns, united by name.

    Snapshots written over the years may differ in their columns.  Files with
    the same header are read together, so the plan grows with the number of
    different headers and not of files.  The row-index column is dropped, the
    snapshot date parsed (it comes in two layouts).
    """
    groups = _headers(spark, path, glob)
    if not groups:
        raise FileNotFoundError(f"no snapshot files match {glob} in {path}")
    reader = spark.read.options(**CSV_OPTIONS)
    parts = [reader.csv(files) for files in groups.values()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop(ROW_INDEX_COLUMN, "_c0")
    return united.withColumn(date, archive_date(date)) if date in united.columns else united


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The date-partitioned snapshot zone; later columns are null in older dates."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(ROW_INDEX_COLUMN)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A sheet exported with a title line above its header line.

    The reader takes the title for the header and skips it in every file; the
    real header then arrives as a row that repeats the column names.  All columns are text, codes
    such as "01" included.
    """
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    rows = spark.read.schema(text).options(**CSV_OPTIONS, enforceSchema="true").csv(path)
    first = schema.names[0]
    return rows.filter(F.col(first).isNull() | (F.col(first) != first))


def source_urls(*registries: tuple[DataFrame, str, str]) -> DataFrame:
    """(name, url) of every registered source; each argument is (registry, name column, link column)."""
    parts = [df.select(F.col(name).alias("name"), F.col(link).alias("url")) for df, name, link in registries]
    return reduce(DataFrame.unionByName, parts)
