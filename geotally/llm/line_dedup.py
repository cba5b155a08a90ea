"""Line deduplication: drop lines that many documents share, keep one copy.

Plan: explode each document's normalised lines once and write their hashes, ids and positions;
count distinct documents per hash (partial sums before the shuffle, so a line of every third
document is a few partial rows), join the frequent hashes back to the line occurrences, gather
each document's dropped positions and cut them out of the split text.  Only hashes of 128 bits,
ids and positions are shuffled, and each text once at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import SPACES, cut, lower_ascii, written


def line_key(line):
    """A line without the six ASCII spaces at both ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def drop_frequent_lines(
    docs: DataFrame,
    *,
    min_docs: int = 5,
    min_chars: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points and is in ``min_docs`` documents.

    Such a key's lines stay only in the largest id that has it (all of them there).  All
    columns of ``docs`` are returned, the text replaced, with ``n_lines`` and ``n_dropped``
    (long) behind them; columns of those names in the input are replaced.

    A null or empty text is one empty line and comes back as the empty text.  Rows with a null
    id count as no document and keep all lines.  Rows that repeat an id count as one document.
    An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Rows that repeat an id are told apart by their texts.  A generator's other columns are
    # evaluated for each line, so the hash of the whole text is a column before it.
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.length("text") >= min_chars)
    exploded = texts.select("id", "text", F.xxhash64("text").alias("version")).select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = line_key(F.col("line"))
    lines = written(
        exploded.where(F.col("id").isNotNull() & (F.length("line") >= min_chars) & (F.length(F.trim("line", F.lit(SPACES))) >= min_chars))
        .select("id", "version", "at", F.xxhash64(key).alias("hash"), F.xxhash64(F.lit(1), key).alias("hash2")),
        "lines",
    )
    # One row per document and line first, so that the count below is of distinct documents.
    # The table is written, so that the join back deals both its sides and can split a hot line.
    frequent = cut(
        lines.select("hash", "hash2", "id").distinct()
        .groupBy("hash", "hash2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("hash", "hash2", "keeper")
    )
    dropped = (
        lines.join(frequent, ["hash", "hash2"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy(F.col("id").alias("of_id"), F.col("version").alias("of_version"))
        .agg(F.sort_array(F.collect_set("at")).alias("gone"))
    )
    # The document's own columns travel as one, so that none clashes with the names used here.
    whole = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("version"))
    joined = whole.join(dropped, (F.col("id") == F.col("of_id")) & (F.col("version") == F.col("of_version")), "left")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    split = F.split(text, "\n", -1)
    n = F.size(split)
    # The kept lines are the slices between one dropped position and the next.
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), F.col("gone")),
            F.concat(F.col("gone"), F.array(n)),
            lambda a, b: F.slice(split, a + 2, b - a - 1),
        )
    )
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(left if c == text_col else F.col("row").getField(c)).alias(c) for c in columns],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
