"""The stored index: a Parquet table with a fixed schema, replaced as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.operators.store import upsert
from codeweir.sources.readers import DOCUMENT

SCHEMA = f"{DOCUMENT}, search_text string, embedding array<float>"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _replace(df: DataFrame, path: str) -> None:
    """Write df beside the table, then put it in the table's place: readers see the former rows or all new ones. If the
    last step fails the former table is put back."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, former = f"{path.rstrip('/')}-new-{mark}", f"{path.rstrip('/')}-old-{mark}"
    df.write.parquet(fresh)
    fs, place = _path(spark, path)
    _, new = _path(spark, fresh)
    _, old = _path(spark, former)
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"cannot replace {path}")
    if had:
        fs.delete(old, True)
    refresh(spark, path)


def initialise(spark: SparkSession, path: str, schema: str = SCHEMA) -> None:
    """Make the empty table if it is not there; an existing one is left as it is."""
    fs, place = _path(spark, path)
    if not fs.exists(place):
        spark.createDataFrame([], schema).write.parquet(path)


def clear(spark: SparkSession, path: str, schema: str = SCHEMA) -> None:
    _replace(spark.createDataFrame([], schema), path)


def refresh(spark: SparkSession, path: str) -> None:
    spark.catalog.refreshByPath(path)


def upsert_into(spark: SparkSession, path: str, batch: DataFrame, dimension: int, key: str = "id") -> None:
    """Rows of a batch (with an ordinal _seq) replace those of the table, all or none: a vector of another size than
    dimension, or a row without a key, fails the batch before anything is written."""
    wrong = batch.where(F.col(key).isNull() | ~F.coalesce(F.size("embedding") == dimension, F.lit(False)))
    first = wrong.select(key).limit(1).collect()
    if first:
        raise ValueError(f"{first[0][key]}: no vector of {dimension} numbers, or no key")
    table = spark.read.schema(batch.drop("_seq").schema).parquet(path)
    _replace(upsert(table, batch, key), path)
