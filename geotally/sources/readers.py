"""Readers with explicit schemas; drift raises, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIPE_XML = """`識別碼` string, `起點編號` string, `終點編號` string, `LineString` struct<`_srsName`:string,`_srsDimension`:string,`posList`:string>, `設置日期` struct<`timePosition`:string>,
`尺寸單位` string, `管徑寬度` string, `管徑高度` string, `管線材料` string, `起點埋設深度` string, `終點埋設深度` string, `管線長度` string, `作業區分` string, `管線型態` string, `使用狀態` string, `資料狀態` string"""


def same_schema(df: DataFrame, schema: str) -> DataFrame:
    """The table, if its columns are exactly those of the schema."""
    want = df.sparkSession.createDataFrame([], schema).schema
    got = [(f.name, f.dataType) for f in df.schema]
    if got != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"expected {want.simpleString()}, got {df.schema.simpleString()}")
    return df


def pipes_xml(spark: SparkSession, path: str, row_tag: str = "UTL_管線") -> DataFrame:
    """Segments of a GML file, namespaces ignored; coordinates as an array of points."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(PIPE_XML).load(path)
    dimension = F.coalesce(F.col("LineString._srsDimension").cast("int"), F.lit(2))
    numbers = F.transform(F.filter(F.split(F.col("LineString.posList"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    at = lambda i, k: F.get(F.col("__n"), i * F.col("__d") + k)
    n = F.floor(F.size("__n") / F.col("__d"))
    points = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"))))
    return rows.withColumns({"__n": numbers, "__d": dimension}).withColumn("points", points).drop("__n", "__d")


def csv(spark: SparkSession, path: str, schema: str, *, required: list[str] = ()) -> DataFrame:
    """CSV with a header (a byte-order mark is no part of it); rows that lack a required field raise."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).schema(schema).csv(path)
    for c in required:
        df = df.where(F.assert_true(F.col(c).isNotNull(), f"{c} is required").isNull())
    return df


def json_envelope(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of ``result.results`` of a JSON document."""
    return spark.read.option("multiLine", True).schema(f"result struct<results:array<struct<{item}>>>").json(path).select(F.inline("result.results"))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


# What an outcome file calls the outcomes, the states that admit them, and the place.
OUTCOME, APPROVED, CITY = "鼠蹤", ("已審核", "已通報1999"), "臺北市"


def approved_outcomes(rows: DataFrame) -> DataFrame:
    """``report_id``, ``lat``, ``lon`` and ``reported_at`` of the rows of an outcome file (all text)
    that have the right type, an admitted state, a place in the city, and a place and time that
    can be read; the others are left out.

    The id is the hash of the row's canonical JSON, so rows that repeat one another are one report.
    """
    from geotally.functions.scalars import finite, json_digest

    kept = rows.where((F.col("類型") == OUTCOME) & F.col("狀態").isin(*APPROVED) & F.col("地點").startswith(CITY))
    whole = json_digest(**{c: F.col(c) for c in rows.columns})
    time = F.try_to_timestamp(F.col("通報時間"), F.lit("yyyy-MM-dd HH:mm"))
    read = kept.select(whole.alias("report_id"), finite(F.col("緯度")).alias("lat"), finite(F.col("經度")).alias("lon"), time.alias("reported_at"))
    return read.where("lat IS NOT NULL AND lon IS NOT NULL AND reported_at IS NOT NULL").dropDuplicates(["report_id"])


def outcomes_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``approved_outcomes`` of a CSV file with these columns."""
    return approved_outcomes(csv(spark, path, ", ".join(f"`{c}` string" for c in columns)))


def empty_stage(df: DataFrame) -> DataFrame:
    """No row, with the columns and types of a table."""
    return df.sparkSession.createDataFrame([], df.schema)


def namespace(spark: SparkSession, name: str) -> None:
    """A database of this name, if there is none."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def known_only(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """The rows, if the column has known values only; another value raises."""
    return df.where(F.assert_true(F.coalesce(F.col(column).isin(*known), F.lit(False)), f"{column} has an unknown value").isNull())


def address_points(spark: SparkSession, path: str, columns: list[str], district: str, codes: list[str]) -> DataFrame:
    """Official address points (CSV, all text) of the districts asked for; a file with other columns raises."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if rows.columns != columns:
        raise ValueError(f"expected columns {columns}, got {rows.columns}")
    return rows.where(F.col(district).isin(*codes))


def preview(spark: SparkSession, path: str, schema: str, flags: list[str], state: str, states: list[str]) -> DataFrame:
    """Rows of a JSON array whose flags are booleans or their names as text; other flags and unknown
    states raise."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    for c in flags:
        value = F.lower(F.col(c).cast("string"))
        known = value.isNull() | value.isin("true", "false")
        rows = rows.where(F.assert_true(known, f"{c} is no boolean").isNull()).withColumn(c, value == "true")
    return known_only(rows, state, states)
