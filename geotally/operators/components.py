"""Connected components of a link table, by alternating large-star and small-star steps.

Each step replaces every link by one to the smallest node known in its neighbourhood, so the
number of rounds grows with the logarithm of a component's width.  A node's smallest
neighbour is a grouped minimum with partial sums, and it is written to the shared folder
before it is joined back, so that a node with very many links is a join that the engine can
split.  Nothing is collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.operators.ranking import small
from geotally.storage import cut, release


#: Links of a partition, about: few links lie in few files, however many partitions shuffles have.
PART_LINKS = 100_000


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node`` and ``label`` (the smallest of a node and its neighbours, written), and the links between labels: two columns of
    ends, each pair once, the smaller first.

    A node's root is its label's, or the label itself if that has no link to another.  Many links among few nodes leave few links.
    ``links`` as for ``components``, read three times; links from a node to itself say nothing.
    """
    a, b = links.columns
    ends = links.where(F.col(a) != F.col(b))
    both = ends.select(F.col(a).alias("node"), F.col(b).alias("to")).unionByName(ends.select(F.col(b).alias("node"), F.col(a).alias("to")))
    labels = small(both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("label")))
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    met = ends.select(F.col(a).alias("a"), F.col(b).alias("b")).join(at("a"), "a").join(at("b"), "b").where("a_label != b_label")
    return labels, met.select(F.least("a_label", "b_label").alias(a), F.greatest("a_label", "b_label").alias(b)).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of node ids of one type; returns ``node`` and ``root``.

    One row for each node that has a link to another node; ``root`` is the smallest node of
    its component.  Links with a null end and links from a node to itself say nothing;
    repeated links count once.  No links: an empty table.
    """
    a, b = links.columns
    now = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    state = _state(now)
    # Links never become more, so this many partitions are enough for every step.
    few = lambda df: df.coalesce(state[0] // PART_LINKS + 1)
    now = few(now)
    while state[0]:
        both = now.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionByName(
            now.select(F.col("lo").alias("at"), F.col("hi").alias("to"))
        )
        least = cut(few(both.groupBy("at").agg(F.min("to").alias("to_min")).select("at", F.least("at", "to_min").alias("low"))))
        large = cut(few(both.where("to > at").join(least, "at").select(F.col("to").alias("hi"), F.col("low").alias("lo")).distinct()))
        least = cut(few(large.groupBy("hi").agg(F.min("lo").alias("low"))))
        small = (
            large.join(least, "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
            .unionByName(least.select("hi", F.col("low").alias("lo")))
            .distinct()
        )
        now = cut(few(small))
        was, state = state, _state(now)
        release(links.sparkSession)
        if was == state:
            break
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
