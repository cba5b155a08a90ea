"""Ranking without a single-partition window.

A rank over a whole table, written as a window without partitions, sorts all rows in one
task.  Ranks, percent ranks and running sums that don't depend on the order of ties only need
the weight of all smaller values.  So the values are counted first (partial sums), dealt to
ranges, and the ranges' totals (one row per range) give each range its offset; only distinct
values move, and no task gets more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.storage import cut

#: Up to so many distinct values (of all keys) one window is as good as ranges.
FEW_VALUES = 200_000
#: Tables of up to so many rows (a row or a few a key) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """The table, written, and broadcast if its size allows it."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def below(df: DataFrame, keys: list[str], value: str, weights: dict[str, str | Column], *, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """For each key and distinct non-null value: each weight's sum (``<name>``) and its sum over
    the values before it (``<name>_before``).

    ``weights`` must be additive without rounding in any order (counts, integers, decimals).
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the count, the sample of the ranges and the sums all read it.
    totals = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(w).alias(k) for k, w in weights.items()]))
    order = F.col(value).desc() if descending else F.col(value).asc()
    if ranges is None and totals.count() <= FEW_VALUES:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, value, *weights, *[F.coalesce(F.sum(k).over(whole), F.lit(0)).alias(f"{k}_before") for k in weights])
    ranged = cut(totals.repartitionByRange(n, *keys, order).withColumn("__range", F.spark_partition_id()))
    per_range = ranged.groupBy(*keys, "__range").agg(*[F.sum(k).alias(k) for k in weights])
    across = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__range").alias("__r"), *[F.coalesce(F.sum(k).over(across), F.lit(0)).alias(f"__{k}_offset") for k in weights])
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(*keys, value, "__range", *weights, *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(f"{k}_before") for k in weights])
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    joined = local.join(small(offsets), [*same, F.col("__range") == F.col("__r")])
    return joined.select(*keys, value, *weights, *[(F.col(f"{k}_before") + F.col(f"__{k}_offset")).alias(f"{k}_before") for k in weights])


def running(df: DataFrame, keys: list[str], score: str, tie: str, weight: str | Column, *, name: str, ranges: int | None = None) -> DataFrame:
    """All rows with ``name``: the sum of ``weight`` up to the row in its key, by falling score
    (nulls last) and then by ``tie``, which must be unique within a key.

    The order is by score and tie together, so rows that tie at one score are dealt to ranges too.
    """
    place = F.struct(F.col(score).isNull().alias("unscored"), (-F.col(score)).alias("score"), F.col(tie).alias("tie"))
    sums = below(df.withColumn("__place", place), keys, "__place", {"__taken": weight}, ranges=ranges)
    up_to = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__place.tie").alias("__tie"), (F.col("__taken") + F.col("__taken_before")).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(up_to, [*same, F.col(tie) == F.col("__tie")]).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str], *, first: int = 1, name: str = "row", ranges: int | None = None) -> DataFrame:
    """All rows numbered in order: ranges of the order are numbered apart, behind the sizes of the
    ranges before (one row a range)."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__r", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    joined = ranged.withColumn("__own", own).join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return joined.select(*df.columns, (F.col("__own") + F.col("__before") + (first - 1)).cast("long").alias(name))


def percent_rank(df: DataFrame, keys: list[str], value: str, *, descending: bool = False, name: str = "score") -> DataFrame:
    """All rows with ``name``: the share of the other scored rows that are before the row's value.

    Rows with a null value have a null score and count for none; equal values share a score;
    a lone row has 0.
    """
    ranks = below(df, keys, value, {"__n": F.lit(1)}, descending=descending)
    ranks = ranks.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {value: "__value"})
    sizes = ranks.groupBy(*[F.col(f"__k_{k}").alias(f"__s_{k}") for k in keys]).agg(F.sum("__n").alias("__all"))
    on = [F.col(f"__k_{k}").eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    counted = ranks.join(small(sizes), on) if keys else ranks.crossJoin(F.broadcast(sizes))  # a row for each key
    share = F.when(F.col("__all") > 1, F.col("__n_before") / (F.col("__all") - 1)).otherwise(F.lit(0.0)).cast("double")
    scored = counted.select(*[f"__k_{k}" for k in keys], "__value", share.alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(scored, [*same, F.col(value) == F.col("__value")], "left").select(*df.columns, name)


def top_share(df: DataFrame, keys: list[str], score: str, area: str | Column, *, share: float = 0.10, total: DataFrame | None = None, name: str = "selected") -> DataFrame:
    """All rows with ``name``: whether the row's score reaches the threshold of the top ``share`` of area.

    The threshold is the least score before which less than that share of the whole area is
    taken; all rows that tie with it are selected.  The whole area includes unscored rows
    (or is ``total``: ``keys`` and ``area_total``); those are never selected.
    """
    ordered = below(df, keys, score, {"__area": area}, descending=True)
    whole = total if total is not None else df.groupBy(*keys).agg(F.sum(area).alias("area_total"))
    thresholds = (
        ordered.join(small(whole), keys)
        .where(F.col("__area_before") < F.lit(share) * F.col("area_total"))
        .groupBy(*keys).agg(F.min(score).alias("threshold"))
    )
    joined = df.join(small(thresholds), keys, "left")
    return joined.select(*df.columns, "threshold", F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], *, kind: str = "linear") -> DataFrame:
    """``keys`` and a column for each of ``points``: exact quantiles of the non-null values.

    ``linear`` interpolates between neighbours, ``lower`` takes the neighbour below, ``discrete``
    the first value that the share of rows reaches.  No group's values meet in one place:
    positions are found among counted values (see ``below``).
    """
    counted = below(df, keys, value, {"__rows": F.lit(1)})
    sizes = counted.groupBy(*keys).agg(F.sum("__rows").alias("__n")).withColumnsRenamed({k: f"__s_{k}" for k in keys})
    joined = counted.join(small(sizes), [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]) if keys else counted.crossJoin(F.broadcast(sizes))  # a row for each key

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("__rows_before") <= index) & (index < F.col("__rows_before") + F.col("__rows")), F.col(value)))

    columns = []
    for name, q in points.items():
        place = F.ceil(F.col("__n") * q) - 1 if kind == "discrete" else (F.col("__n") - 1) * F.lit(float(q))
        if kind == "linear":
            low, high = at(F.floor(place)), at(F.ceil(place))
            part = F.max(place - F.floor(place))
            columns.append((low + (high - low) * part).alias(name))
        else:
            columns.append(at(F.greatest(F.lit(0), F.floor(place))).alias(name))
    return joined.groupBy(*keys).agg(*columns)
