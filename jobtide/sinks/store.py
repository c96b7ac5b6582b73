"""Snapshot zone and history tables: Parquet, partitioned by snapshot date.

Writes are idempotent by date.  With dynamic partition overwrite a write
replaces exactly the dates it carries, so a re-run of a day never doubles it,
and the cost of a week does not depend on the length of the history.

A table that is replaced as a whole keeps its rows in versions below its folder.  The newest file in
``_current`` names the one that counts; it is empty and written last, so a version is either
there for readers or not.  Read tables through ``read_history``, which looks the version up.

A table partitioned by date that holds no rows has no files that tell its columns.  They are kept below ``_columns`` then.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import repair_title
from ..operators.asof import DATE
from ..operators.ordering import keep_first
from ..operators.quality import QualityError, require_same_columns
from ..schemas import RUN_LOG, SALARY_HISTORY, empty
from ..session import settled, settled_for_now
from ..sources.files import read_snapshots

VERSIONS, CURRENT, COLUMNS = "_versions", "_current", "_columns"
#: The version in use and the one before it, which running readers may still read.
KEPT_VERSIONS = 2


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing if it is not there."""
    fs, folder = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _file_system(spark, path)
    fs.delete(jvm_path, True)


def location(spark: SparkSession, path: str) -> str:
    """The folder with the table's rows: its newest version, or the table's own folder if it has none."""
    pointers = _names(spark, f"{path}/{CURRENT}")
    return f"{path}/{VERSIONS}/{pointers[-1].partition('.')[2]}" if pointers else path


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the table has a folder that holds anything."""
    return bool(_names(spark, location(spark, path)))


def stored_dates(spark: SparkSession, path: str, date: str = DATE) -> list[dt.date]:
    """The dates a table has rows for, from its partition folders."""
    found = (re.fullmatch(rf"{re.escape(date)}=(\d{{4}}-\d\d-\d\d)", n) for n in _names(spark, location(spark, path)))
    return sorted(dt.date.fromisoformat(m[1]) for m in found if m)


def _holds_rows(spark: SparkSession, folder: str) -> bool:
    """Whether Spark's readers find files or dates in the folder."""
    return any(not n.startswith(("_", ".")) for n in _names(spark, folder))


def _keep_columns(df: DataFrame, folder: str, date: str) -> None:
    """If the folder was left without rows, keep the frame's columns in it, the date last as readers give it."""
    if not _holds_rows(df.sparkSession, folder):
        columns = T.StructType([*[f for f in df.schema.fields if f.name != date], df.schema[date]])
        empty(df.sparkSession, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{COLUMNS}/none")


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the one that counts: one empty file is created, which is there or is not."""
    pointers = _names(spark, f"{path}/{CURRENT}")
    number = int(pointers[-1].partition(".")[0]) + 1 if pointers else 1
    fs, pointer = _file_system(spark, f"{path}/{CURRENT}/{number:012d}.{version}")
    if not fs.createNewFile(pointer):
        raise OSError(f"could not create {pointer}")


def _forget_old(spark: SparkSession, path: str) -> None:
    """Delete what only older pointers name, the rows of a time before versions included."""
    pointers = _names(spark, f"{path}/{CURRENT}")
    for pointer in pointers[:-KEPT_VERSIONS]:
        _delete(spark, f"{path}/{VERSIONS}/{pointer.partition('.')[2]}")
        _delete(spark, f"{path}/{CURRENT}/{pointer}")
    if len(pointers) >= KEPT_VERSIONS:
        for name in _names(spark, path):
            if name not in (VERSIONS, CURRENT):
                _delete(spark, f"{path}/{name}")


def replace_tables(frames: dict[str, DataFrame], by: str | None = None) -> None:
    """Write whole tables anew, {path: rows}; all of them are written before the first one counts.

    A frame may be read from the table it replaces.  If a write fails, no table has changed and what
    was written is deleted; if the process is killed, no table has changed.
    """
    versions = {path: uuid.uuid4().hex for path in frames}
    try:
        for path, df in frames.items():
            writer = df.hint("rebalance", F.col(by)).write.partitionBy(by) if by else df.write
            writer.parquet(f"{path}/{VERSIONS}/{versions[path]}")
            if by:
                _keep_columns(df, f"{path}/{VERSIONS}/{versions[path]}", by)
    except BaseException:
        for path, df in frames.items():
            _delete(df.sparkSession, f"{path}/{VERSIONS}/{versions[path]}")
        raise
    for path, df in frames.items():
        _point(df.sparkSession, path, versions[path])
        _forget_old(df.sparkSession, path)


def replace_table(df: DataFrame, path: str, date: str = DATE) -> None:
    """Write a table partitioned by date anew, so that nothing of the old one stays."""
    replace_tables({path: df}, date)


def _dates_in(df: DataFrame, date: str) -> list:
    """The distinct dates, at most two of them: enough to tell one from many."""
    return [r[0] for r in df.select(date).distinct().limit(2).collect()]


def _write_dates(df: DataFrame, path: str, date: str) -> None:
    (
        df.hint("rebalance", F.col(date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date)
        .parquet(path)
    )


def replace_dates(df: DataFrame, path: str, dates: Iterable[dt.date] | None = None, date: str = DATE) -> None:
    """Write the frame's dates, replacing those dates and no others.

    ``dates`` names the dates that were derived again: those of them the frame has no
    rows for are cleared, as that is what is now known of them, after the others are written.  The frame is
    evaluated once.  Rows are gathered by date before writing, so a date gets few files; adaptive
    execution cuts a date that holds most of the rows into several write tasks.
    """
    spark = df.sparkSession
    target = location(spark, path)
    folders = [f"{target}/{date}={d}" for d in dates or ()]
    before = {folder: _names(spark, folder) for folder in folders}
    _write_dates(df, target, date)
    # A date that was written holds new files, whose names occur once.
    for folder, names in before.items():
        if names and _names(spark, folder) == names:
            _delete(spark, folder)
    _keep_columns(df, target, date)


def write_snapshot(df: DataFrame, path: str, date: str = DATE) -> None:
    """Archive a raw snapshot (before names are canonicalised)."""
    replace_dates(df, path, date=date)


def replaced(existing: DataFrame, new: DataFrame, date: str = DATE) -> DataFrame:
    """The frame an append by date leads to, without writing: the dates of
    ``new`` are dropped from ``existing``, then both are united."""
    dates = new.select(date).distinct()
    return existing.join(dates, date, "left_anti").select(*existing.columns).unionByName(new)


def append_by_date(new: DataFrame, path: str, schema: T.StructType | None = None, date: str = DATE) -> DataFrame:
    """Add one snapshot date to a history table and return the whole table.

    No new rows leave the table as it is; more than one date, or columns that differ from
    the table's in name or type, are refused before anything is written.
    """
    spark = new.sparkSession
    exists = table_exists(spark, path)
    dates = _dates_in(new, date)
    if len(dates) > 1:
        raise QualityError(f"append_by_date: expected exactly one {date}, got {sorted(map(str, dates))} ...")
    if not dates:
        return read_history(spark, path, schema) if exists else new
    if exists:
        require_same_columns(read_history(spark, path, schema).schema, new.schema, "append_by_date")
    replace_dates(new, path, date=date)
    return read_history(spark, path, schema)


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table's rows, of its newest version if it has versions.  With a schema, a table that is not there is empty;
    one that was written and holds no rows is empty in any case."""
    if schema is None:
        folder = location(spark, path)
        kept = f"{folder}/{COLUMNS}/none"
        return spark.read.parquet(kept if _names(spark, kept) and not _holds_rows(spark, folder) else folder)
    return spark.read.schema(schema).parquet(location(spark, path)) if table_exists(spark, path) else empty(spark, schema)


# -- year-keyed archive ------------------------------------------------------


def missing_year_rows(existing: DataFrame, snapshot: DataFrame, keys: tuple[str, str] = ("District", "Salary_Year"), order: str | None = None) -> DataFrame:
    """Snapshot rows whose (entity, year) the archive does not have, each pair once.

    Of several rows of a pair the first by ``order`` stays; without one, the row with the
    fewest missing values, then the one with the smallest values.
    """
    others = [c for c in snapshot.columns if c not in keys]
    missing = sum((F.col(c).isNull().cast("int") for c in others), F.lit(0))
    once = keep_first(snapshot, list(keys), [order] if order else [missing, *[F.asc_nulls_last(c) for c in others]])
    return once.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*snapshot.columns)


def archive_year_snapshot(current: DataFrame, path: str, schema: T.StructType = SALARY_HISTORY) -> bool:
    """Append the (entity, year) pairs the archive lacks; true if any were added.

    Does nothing unless the current table carries exactly one year.  Running it
    again adds nothing; a year that was archived in part is completed.
    """
    spark = current.sparkSession
    years = [r[0] for r in current.select("Salary_Year").filter("Salary_Year is not null").distinct().limit(2).collect()]
    if len(years) != 1:
        return False
    snapshot = current.filter(F.col("Salary_Year") == years[0]).select(
        *[F.col(f.name).cast(f.dataType) for f in schema.fields]
    )
    existing = read_history(spark, path, schema)
    with settled_for_now(missing_year_rows(existing, snapshot)) as missing:
        if missing.isEmpty():
            return False
        missing.write.mode("append").parquet(path)
    return True


# -- current tables, log, export ---------------------------------------------


def overwrite_table(df: DataFrame, path: str) -> None:
    """Full refresh.  The frame may have been read from the table itself."""
    replace_tables({path: df})


def append_log(audit: DataFrame, path: str, at: dt.datetime) -> None:
    """Add an ingest audit (source, status, n_rows, error_message) to the run log."""
    audit.withColumn("timestamp", F.lit(at)).select(*RUN_LOG.names).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a derived view as CSV with a header, quotes doubled, NA for missing."""
    df.write.mode("overwrite").options(header="true", escape='"', nullValue="NA").csv(path)


# -- whole-archive jobs ------------------------------------------------------


def repair_archive(spark: SparkSession, path: str, column: str = "title", apply: bool = False, date: str = DATE) -> DataFrame:
    """Report (date, file, original, repaired) for the texts that byte or mojibake repair would change; with
    ``apply`` rewrite the files that hold any, and only those.

    A file keeps its name and its other rows.  The new file is complete before the old one is set aside,
    and the old one is deleted only once the new one has its place; if a file cannot be put in
    place the old one is put back.  ``file`` is the path as Spark gives it.
    """
    archive = spark.read.option("mergeSchema", "true").parquet(path)
    if column not in archive.columns:
        raise ValueError(f"repair_archive: no column {column!r}")
    both = archive.withColumns({"_repaired": repair_title(column), "file": F.col("_metadata.file_path")})
    report = both.filter(F.col(column) != F.col("_repaired")).select(
        date, "file", F.col(column).alias("original"), F.col("_repaired").alias("repaired")
    )
    if not apply:
        return report
    report = settled(report)
    # One short row for each file with a change; the files themselves are read and written by tasks.
    touched = {r["file"]: r["key"] for r in report.select("file", F.hex(F.xxhash64("file")).alias("key")).distinct().collect()}
    if not touched:
        return report
    dates = [r[0] for r in report.select(date).distinct().collect()]
    keys = spark.createDataFrame([(f,) for f in touched], "file string")
    fixed = both.filter(F.col(date).isin(dates)).join(keys, "file", "left_semi")
    fixed = fixed.withColumns({column: F.col("_repaired"), "_key": F.hex(F.xxhash64("file"))})
    staged = f"{path}/_repair-{uuid.uuid4().hex}"
    # A file's rows fit one task as they stood in one file; the date is in the folder's name.
    fixed.select(*[c for c in archive.columns if c != date], "_key").repartition("_key").sortWithinPartitions("_key").write.partitionBy("_key").parquet(staged)
    for file, key in touched.items():
        _put_in_place(spark, f"{staged}/_key={key}", file)
    _delete(spark, staged)
    return report


def _put_in_place(spark: SparkSession, folder: str, file: str) -> None:
    """Put the only file of ``folder`` in the place of ``file``; the old one is put back if that fails."""
    parts = [n for n in _names(spark, folder) if n.startswith("part-")]
    if len(parts) != 1:
        raise OSError(f"expected one file in {folder}, found {len(parts)}")
    uri = spark._jvm.java.net.URI(file)
    old = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), f"_old-{old.getName()}")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{parts[0]}")
    if not fs.rename(old, aside):
        raise OSError(f"could not set {file} aside")
    if not fs.rename(fresh, old):
        fs.rename(aside, old)
        raise OSError(f"could not replace {file}")
    fs.delete(aside, False)


def rebuild(
    spark: SparkSession, raw_path: str, derive: Callable[[DataFrame], dict[str, DataFrame]], targets: dict[str, str], date: str = DATE
) -> None:
    """Derive all tables again from the raw snapshots.

    ``derive`` maps the snapshots of any number of dates to named frames, the
    same function the weekly append uses, so a rebuild equals the
    appends week by week.  Whole tables are replaced: a date that is no longer in the
    archive is no longer in them either.
    """
    frames = derive(read_snapshots(spark, raw_path))
    replace_tables({path: frames[name] for name, path in targets.items()}, date)
