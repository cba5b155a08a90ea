"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geotally.plans import contracts, evaluation, geometry, ingest, layers, network, pipes, serving, spatial, streams  # noqa: F401
from geotally.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer ranking with the top-area selection."""
    return QUERIES["layer_rank_topk_area"](spark, sf_dir)
