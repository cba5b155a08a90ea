"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.storage import cut, release, scratch, shared_dir

__all__ = ["SPACES", "cut", "fold", "held", "lower_ascii", "release", "scratch", "shared_dir", "table", "written"]

#: White space of the text contracts, the six ASCII characters 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


_HELD: dict = {}


def held(key, make):
    """The one object that a Python worker keeps from task to task; another key replaces it.

    Workers outlive stages, so tables of one operator must not stay while another one runs.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z in lower case, all other characters as they are."""
    spelt_out = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # As many bytes as characters: all are ASCII, and lower() does the same several times faster.
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(spelt_out)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows written as a table in the shared folder, for several readers."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id", parts: int = 5):
    """crc32 of the id's decimal text modulo ``parts`` (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
