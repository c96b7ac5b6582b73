"""From raw documents to packed sequences: filter, clean, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of
documents; between stages the rows are written as Parquet and read again.  Null and empty texts, long
texts, repeated rows and empty tables pass through as each operator's docstring says.  Extra columns come back as they
were, whatever their names are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm import decontaminate, lines, neardup, packing, quality
from jobtide.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aside(docs: DataFrame, computed: Iterable[str]) -> DataFrame:
    """The same rows with plain names for columns that an operator's own would replace, or whose names hold dots or
    backticks; columns keep their places."""
    taken = {c.lower() for c in computed}
    odd = lambda c: c.lower() in taken or not re.fullmatch(r"\w+", c)
    return docs.toDF(*[f"aside_{i}" if odd(c) else c for i, c in enumerate(docs.columns)])


def _kept(found: DataFrame, aside: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order and under their own names again."""
    return found.select(*aside.columns).toDF(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the neighbour vote does not reject."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    aside = _aside(docs, ("score", "predicted"))
    return _kept(quality.score_quality(aside, model).where("predicted = 1"), aside, docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents; n_chars follows the text."""
    aside = _aside(docs, ("n_lines", "n_dropped"))
    cleaned = lines.drop_recurring(aside)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", changed)
    return _kept(cleaned, aside, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    aside = _aside(docs, ())
    return _kept(neardup.keep_one(aside), aside, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words stands in benchmark phrases."""
    aside = _aside(docs, [f.name for f in decontaminate.FIELDS])
    found = decontaminate.find_contamination(aside, _table(spark, sf_dir, "benchmark"))
    return _kept(found.where(~F.col("contaminated")), aside, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with the sequence and offset of each."""
    return packing.pack(docs, ["doc_id"])


STAGES = [
    ("quality", filter_quality),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the quality score, the signatures and the tokeniser are out of its reach. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.settle(stage(spark, docs, sf_dir), str(number))
        if number:
            work.drop(str(number - 1))
    return work.finish(STAGES[-1][1](spark, docs, sf_dir))
