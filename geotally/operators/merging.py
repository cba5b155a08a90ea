"""Immutable snapshots: insert-only merge, conflicts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.storage import cut


class GateError(AssertionError):
    """A condition that must hold before or after a step does not."""


def gate(condition: DataFrame, message: str) -> None:
    """Raise unless the one boolean of a one-row table is true."""
    row = condition.first()
    if row is None or row[0] is not True:
        raise GateError(message)


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One boolean: whether no two rows share a key (partial counts by key)."""
    return df.groupBy(*keys).count().agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("holds"))


def conflicts(target: DataFrame, stage: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Staged rows whose key is in the target with another digest."""
    old = target.select(*keys, F.col(digest).alias("__old"))
    return stage.join(old, keys).where(~F.col(digest).eqNullSafe(F.col("__old"))).drop("__old")


def insert_only_merge(target: DataFrame, stage: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The target with the staged rows whose key is new; rows are never changed (conflicts raise)."""
    gate(conflicts(target, stage, keys, digest).limit(1).agg((F.count("*") == 0).alias("holds")), "a staged row contradicts a stored one")
    return target.unionByName(stage.join(target.select(*keys), keys, "left_anti"))


def freeze(df: DataFrame, release: str, manifest: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows under a release name, and the one-row manifest of the release."""
    frozen = df.withColumn("release", F.lit(release))
    one = df.agg(F.count("*").alias("n_rows")).select(F.lit(release).alias("release"), F.lit("FROZEN").alias("state"), "n_rows", *[F.lit(v).alias(k) for k, v in manifest.items()])
    return frozen, one


def frozen_only(manifest: DataFrame, release: str) -> None:
    """Outcomes may be read only once a release is frozen, by exactly one manifest row."""
    gate(manifest.where((F.col("release") == release) & (F.col("state") == "FROZEN")).agg((F.count("*") == 1).alias("holds")), f"release {release} is not frozen")


def lock(df: DataFrame, variant: str, chosen: list[str], release: str) -> tuple[DataFrame, DataFrame]:
    """The chosen variants under a release name, and its one-row manifest; a variant that the table
    lacks raises."""
    rows = df.where(F.col(variant).isin(chosen))
    gate(rows.agg((F.countDistinct(variant) == len(set(chosen))).alias("holds")), f"not all of {sorted(chosen)} are there to be locked")
    return freeze(rows, release, {"variants": ",".join(sorted(chosen))})


def open_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts that may be served: for internal simulation, without trusted evidence, prohibited
    for operation and released for nothing."""
    return receipts.where(
        (F.col("use_state") == "INTERNAL_SIMULATION_ONLY") & (F.col("evidence_state") == "NO_TRUSTED_RESULT") & (F.col("operational_use") == "PROHIBITED")
        & ~F.coalesce("public_release_ready", F.lit(False)) & ~F.coalesce("operational_use_ready", F.lit(False))
    )


def served(receipts: DataFrame, maps: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of maps and states with equal keys, of runs whose receipt may be served."""
    runs = open_receipts(receipts).select("run_id").distinct()
    return maps.join(runs, "run_id", "left_semi").join(states, keys)


def first_of_each(requests: DataFrame, keys: list[str], order: str, *, name: str) -> DataFrame:
    """One row for each key: its first request (``name``), how many there were, and how many got
    what was there already."""
    return requests.groupBy(*keys).agg(F.min(order).alias(name), F.count("*").alias("n_requests"), (F.count("*") - 1).alias("n_replayed"))


def creation_states(requests: DataFrame, key: str, digest: str, order: str, stored: DataFrame | None = None) -> DataFrame:
    """All requests with ``run_order`` and ``state``: the first of a key creates its run (CREATED), one with the same digest
    gets it again (REPLAYED), one with another digest is refused (CONFLICT).

    ``stored`` has the keys and digests of runs that exist already: a request for one creates nothing.
    A null key is a run of its own (CREATED).  The first request of a key is a grouped minimum with
    partial sums, written before it is joined back, so a key of very many requests can be split.
    """
    known = requests.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.struct(F.lit(1).alias("age"), F.col(order).alias("at"), F.col(digest).alias("digest")).alias("__run"))
    if stored is not None:
        known = known.unionByName(stored.select(F.col(key).alias("__key"), F.struct(F.lit(0).alias("age"), F.lit(None).cast(requests.schema[order].dataType).alias("at"), F.col(digest).alias("digest")).alias("__run")))
    first = cut(known.groupBy("__key").agg(F.min("__run").alias("__run")))
    joined = requests.join(first, F.col(key) == F.col("__key"), "left")
    same = F.col(digest).eqNullSafe(F.col("__run.digest"))
    created = F.col("__key").isNull() | ((F.col("__run.age") == 1) & (F.col(order) == F.col("__run.at")))
    state = F.when(created, "CREATED").when(same, "REPLAYED").otherwise("CONFLICT")
    return joined.select(*requests.columns, F.when(F.col("__key").isNull(), F.col(order)).otherwise(F.col("__run.at")).alias("run_order"), state.alias("state"))


def one_value_set(records: DataFrame, columns: list[str]) -> DataFrame:
    """The records with ``n_values``, how many of the typed columns are set."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return records.withColumn("n_values", total)


def same_values(df: DataFrame, column: str, expected: list) -> DataFrame:
    """One boolean: whether a column has exactly the expected values (distinct values by partial sums)."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    return found.agg(((F.count("*") == len(set(expected))) & (F.count_if(F.col("v").isin(list(expected))) == F.count("*"))).alias("holds"))
