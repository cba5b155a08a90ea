"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT_SEPARATOR, RECORD_SEPARATOR, LIST_SEPARATOR, NULL_MARK = "\u001f", "\n", "\u001e", "\u0000"


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts with unit separators; null is a mark of its own."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


def table_digest(key: Column, row: Column) -> Column:
    """Aggregate: SHA-256 of the rows' texts in key order (for groups of a bounded size)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("r")))), lambda x: x["r"])
    return F.sha2(F.array_join(ordered, RECORD_SEPARATOR), 256)


def digest_tree(rows: DataFrame, keys: list[str], order: str, text: str, *, levels: int = 4, fan: int = 1024, n: str = "n_rows", leaf: bool = True) -> DataFrame:
    """``keys``, ``digest`` and the number of rows (``n``): the identity of a table of any size.

    ``order`` is a whole number, unique within the keys.  Rows of ``fan`` numbers in a row are
    hashed in their order, then the digests of ``fan`` such pieces, and so on for ``levels``
    levels; what is then left (a digest for each ``fan ** (levels + 1)`` numbers) is hashed as one.
    Without ``leaf`` the rows have digests (``text``) and numbers of rows (``n``) already.
    """
    now = rows.select(*keys, F.col(order).alias("at"), F.col(text).alias("digest"), (F.lit(1) if leaf else F.col(n)).cast("long").alias("n"))
    for _ in range(levels + leaf):
        now = now.groupBy(*keys, F.floor(F.col("at") / fan).alias("piece")).agg(F.sum("n").alias("n"), table_digest(F.col("at"), F.col("digest")).alias("digest"))
        now = now.withColumnRenamed("piece", "at")
    return now.groupBy(*keys).agg(F.sum("n").alias(n), table_digest(F.col("at"), F.col("digest")).alias("digest"))


def is_digest(x: Column) -> Column:
    """Whether a text is a SHA-1 or SHA-256 in lower-case hexadecimal."""
    return x.rlike(r"\A(?:[0-9a-f]{40}|[0-9a-f]{64})\z")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of a row: fields by name, nulls kept, other letters than ASCII as they are."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def json_digest(**fields: Column) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(canonical_json(**fields), 256)


def length_mismatch(reported: Column, measured: Column) -> Column:
    """Whether a reported length is under 0.9 or over 1.1 of the measured one; null without either."""
    ratio = F.when(measured > 0, reported / measured)
    return (ratio < 0.9) | (ratio > 1.1)


def fixed_decimal(x: Column, scale: int) -> Column:
    """Decimal text with a fixed number of places, half to even, without a negative zero."""
    d = F.bround(x.cast(f"decimal(38,{min(scale + 6, 30)})"), scale).cast(f"decimal({min(38, scale + 12)},{scale})")
    return F.when(d == 0, F.lit(0).cast(f"decimal({min(38, scale + 12)},{scale})")).otherwise(d).cast("string")


def finite(x: Column) -> Column:
    """A number from text; null for blanks, NaN and infinities."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def iso_date(x: Column) -> Column:
    return F.try_to_date(x, "yyyy-MM-dd")


def age_years(installed: Column, snapshot: Column) -> Column:
    """Years from one date to the other; null if the first is later."""
    return F.when(installed <= snapshot, F.datediff(snapshot, installed) / F.lit(365.2425))


#: Metres of a unit code (fixed values): millimetre, inch, centimetre, metre.
METRES = {"0": 0.001, "1": 0.0254, "2": 0.01, "3": 1.0}


def metres(x: Column, code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in METRES.items() for v in pair])
    return x * F.try_element_at(table, code)


def circular_diameter(width: Column, height: Column) -> Column:
    """The width where the height is zero and the width is not."""
    return F.when((width > 0) & (height == 0), width)


def mean_of_both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2)


def flags(**conditions: Column) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull()))


def signed64(x: Column) -> Column:
    """An unsigned 64-bit number (decimal) as the signed one with the same bits."""
    d = x.cast("decimal(20,0)")
    return F.when(d >= F.lit("9223372036854775808").cast("decimal(20,0)"), d - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("long")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility form, which Spark lacks."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


#: Numerals of road sections, and dashes between the parts of a house number.
NUMERALS = {"1": "一", "2": "二", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九"}
DASHES = "‐‑‒–—－-"


def normalize_address(x: Column) -> Column:
    """One spelling of an address: compatibility form, no blanks, nothing from a bracket on, a dash
    between digits as "之", section numbers behind a road's name in words, nothing after the
    house number; a null address is empty."""
    s = F.replace(nfkc(F.coalesce(x, F.lit(""))), F.lit("台"), F.lit("臺"))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s　]", ""), r"[（(].*$", "")
    s = F.regexp_replace(s, rf"(?<=[0-9])[{DASHES}](?=[0-9])", "之")
    for digit, word in NUMERALS.items():
        s = F.regexp_replace(s, rf"([路街道]){digit}段", f"$1{word}段")
    return F.when(F.instr(s, "號") > 0, F.concat(F.substring_index(s, "號", 1), F.lit("號"))).otherwise(s)


def phase_group(layer: Column, status: Column, prefix: str, complete: list[str], approved: list[str]) -> Column:
    """Taxonomy of a record's phase by its layer's prefix and its status."""
    return F.when(~F.coalesce(layer.startswith(prefix), F.lit(False)), "OUT_OF_SCOPE").when(status.isin(complete), "COMPLETED").when(status.isin(approved), "APPROVED_NON_COMPLETE").otherwise("OTHER")
