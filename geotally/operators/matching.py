"""Matching of keys to places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Points of a partition, about: what a task holds doesn't grow with the table.
PART_POINTS = 1_000_000


def unambiguous_match(targets: DataFrame, points: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Targets with ``n_rows``, ``n_places``, the place where all points of the key name one, and ``state``.

    Points of keys that no target has are left out; a place is the
    combination of the columns ``place``, of which none may be null.  Points are counted by key and place once they
    are dealt by key: plain sums in parts of about ``PART_POINTS`` points, where a least place of several columns
    would be a sort of all points that a task reads.
    """
    dealt = points.select(*keys, *place).repartition(points.count() // PART_POINTS + 1, *keys)
    found = (
        dealt.groupBy(*keys, *place).agg(F.count("*").alias("n"))
        .groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_places"), *[F.min(c).alias(f"__place_{c}") for c in place])
    )
    state = F.when(F.col("n_places").isNull(), "UNMATCHED").when(F.col("n_places") > 1, "AMBIGUOUS").otherwise("MATCHED")
    joined = targets.join(found, keys, "left")
    return joined.select(*targets.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_places", F.lit(0)).alias("n_places"), *[F.when(F.col("n_places") == 1, F.col(f"__place_{c}")).alias(c) for c in place], state.alias("state"))
