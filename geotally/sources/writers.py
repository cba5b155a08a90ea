"""Sinks: clustered tables, partitioned snapshots, line-delimited JSON, CSV, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clustered(df: DataFrame, path: str, keys: list[str], *, files: int | None = None) -> None:
    """Replace a table, dealt to ranges of its keys and sorted, so that readers can skip row groups."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, path: str, date_col: str, *, required: list[str] = (), lists: list[str] = ()) -> None:
    """Append a snapshot, a folder for each date; a null in a required column or in a list raises."""
    for c in required:
        df = df.where(F.assert_true(F.col(c).isNotNull(), f"{c} is required").isNull())
    for c in lists:
        df = df.where(F.assert_true(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()), f"{c} is a list without nulls").isNull())
    df.write.mode("append").partitionBy(date_col).parquet(path)


def manifest(df: DataFrame, path: str, key: str, **constants: str) -> None:
    """One line of JSON about a table: rows, the digest of its rows by key, and what else is said."""
    from geotally.functions.scalars import canonical_json, digest_tree

    text = canonical_json(**{c: F.col(c) for c in df.columns})
    one = digest_tree(df.select(F.col(key).alias("k"), text.alias("row")), [], "k", "row")
    ndjson(one.select(F.col("digest").alias("rows_sha256"), "n_rows", *[F.lit(v).alias(k) for k, v in constants.items()]), path)


def ndjson(df: DataFrame, path: str) -> None:
    """Line-delimited JSON with sorted keys and null fields kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def feature(geometry: Column, properties: Column) -> Column:
    """GeoJSON text of a feature from a geometry struct and a properties struct."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def features(df: DataFrame, path: str, geometry: Column, properties: list[str], order: str) -> None:
    """One feature a line in key order (a feature sequence, which can be written in parts)."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(feature(geometry, F.struct(*properties)).alias("value")).write.mode("overwrite").text(path)
