"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that differ at no more
than four bits differ at no more than one bit in one of them (five differences or more would be
needed for two in each), so they share a variant of that segment with one bit wiped out.  Each
distinct fingerprint is indexed under its 64 variants (22 + 21 + 21), equal variants are
joined, and the join's condition verifies the distance and lets a pair through at its first
common variant only.  Copies are one fingerprint before anything is joined.

A key has 20 or 21 free bits, so n distinct fingerprints make about n * n / 65,000 chance
candidates (64 keys each, the join's condition ends them): 10^11 at 10^8 fingerprints.
Beyond that the join, not the text, is what costs.

``similar_components`` is for near copies by exact Jaccard similarity: four segments, whose
variants find every pair within seven bits and many beyond, and least hashes of the shingle
sets propose pairs; only pairs whose sets are similar enough become links.  Sketches of the sets
(one bit for each of 128 least hashes) go to the join, whose condition leaves out pairs that they
show to be too different: a family of near copies that aren't similar enough makes few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.bytewords import mix
from geotally.llm.common import cut, release
from geotally.operators.components import components

#: First bit and width of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: With three segments, one has no more than one difference up to this distance.
MAX_DISTANCE = 5
#: The segments of ``similar_components``, and the largest distance of pairs that are compared.
WIDE_SEGMENTS = ((0, 16), (16, 16), (32, 16), (48, 16))
WIDE_DISTANCE = 13
#: Fingerprints that one task makes variants of.
TASK_ROWS = 16_384
#: Odd factors; the least product of a set's hashes with one of them (modulo 2^64) is a key.
FACTORS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Longs of a sketch: a bit of the least product with each of 64 factors more for each.
SKETCH_LONGS = 2
#: Bits of a set's size beside its root's hash (larger sets are not told apart by size).
SIZE_BITS = 24
#: Standard deviations by which a sketch may say less than the similarity that is asked for (a pair in 4,000 says less).
SKETCH_DEVIATIONS = 3.5


def shingle_hashes(text: str | None, shingle_words: int = 4) -> np.ndarray:
    """XXH64 values of a text's word shingles, repeats included (no words: none)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes).tolist(), ends[shingle_words - 1 :].tolist(), strict=False)
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - shingle_words + 1)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """SimHash of a text as a signed 64-bit integer (no words: 0)."""
    return _majority(shingle_hashes(text, shingle_words))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def sketch(hashes: np.ndarray) -> list[int]:
    """Signed longs of one-bit least hashes of a set: two sets agree at a bit with probability (1 + J) / 2."""
    if not len(hashes):
        return [0] * SKETCH_LONGS
    factors = mix(np.arange(1, 64 * SKETCH_LONGS + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (factors[:, None] * hashes[None, at : at + 1024]).min(axis=1), out=least)
    # The upper bits of a least value are nearly all zero; one from the middle is even.
    return np.packbits((least >> np.uint64(17) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sketches_allow(percent: int):
    """Whether the sketches of two rows (columns ``a_...``, ``b_...``) may be of sets so similar."""
    bits, agree = 64 * SKETCH_LONGS, (1 + percent / 100) / 2
    most = bits - int(bits * agree - SKETCH_DEVIATIONS * (bits * agree * (1 - agree)) ** 0.5)
    differ = [F.bit_count(F.col(f"a_sketch{i}").bitwiseXOR(F.col(f"b_sketch{i}"))) for i in range(SKETCH_LONGS)]
    return sum(differ[1:], differ[0]) <= most


def fingerprints(docs: DataFrame, *, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row; nulls in either column are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _segment(fp, k: int, segments=SEGMENTS):
    first, width = segments[k]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _pairs(rows: DataFrame, max_distance: int, segments, also) -> DataFrame:
    """Pairs of rows (columns ``a_...`` and ``b_...``) with a common variant of their ``fp``, no
    more than ``max_distance`` differing bits and the condition ``also``, each pair once."""
    # Segment, wiped bit and the rest of the segment in one number.
    keys_of = [
        F.lit((k << 27) + (i << 22)).bitwiseOR(_segment(F.col("fp"), k, segments).bitwiseAND(F.lit(~(1 << i))).cast("int"))
        for k, (_, width) in enumerate(segments)
        for i in range(width)
    ]
    # One row becomes as many as the fingerprint has bits: many tasks, whatever the table lies in.
    dealt = rows.repartition(rows.count() // TASK_ROWS + 1, "fp")
    keys = dealt.select(*rows.columns, F.explode(F.array(*keys_of)).alias("key"))
    one, two = (keys.withColumnsRenamed({c: f"{side}_{c}" for c in keys.columns}) for side in "ab")
    differ = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    segment, place = F.shiftrightunsigned("a_key", 27), F.shiftrightunsigned("a_key", 22).bitwiseAND(F.lit(31))
    wiped = F.get(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), place)
    first_common = F.lit(False)
    earlier = F.lit(True)
    for k in range(len(segments)):
        own = _segment(differ, k, segments)
        here = (own == wiped) | ((own == 0) & (place == 0))
        first_common = first_common | (earlier & (segment == k) & here)
        earlier = earlier & (F.bit_count(own) > 1)
    # Sizes are estimated without the factor of the explode, so a side that seems small would be broadcast 64 times as large.
    return one.hint("merge").join(two, (F.col("a_key") == F.col("b_key")) & also & (F.bit_count(differ) <= max_distance)).where(first_common)


def links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in column ``fp`` that differ at no more than
    ``max_distance`` bits, each pair once."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"three segments serve distances from 0 to {MAX_DISTANCE}")
    found = _pairs(distinct.select("fp"), max_distance, SEGMENTS, F.col("a_fp") < F.col("b_fp"))
    return found.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))


def near_duplicates(
    docs: DataFrame,
    *,
    shingle_words: int = 4,
    max_distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    A bit of the fingerprint is 1 if it is set in more than half of the XXH64 values (seed 42)
    of the word shingles, repeats included; a text with fewer words is one shingle, a null text
    or one without words has fingerprint 0 and is linked like any other.  ``component_id`` is
    the smallest id that links of at most ``max_distance`` differing bits lead to.  Rows with a
    null id are linked too but name no component (null if no row of the component has an id);
    repeated rows are kept; an empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut(components(links(groups.select("fp"), max_distance)))
    named = (
        roots.join(groups, roots["node"] == groups["fp"])
        .groupBy("root").agg(F.min("first_id").alias("component_id"))
    )
    linked = cut(roots.join(cut(named), "root").select(F.col("node"), "component_id"))
    of_print = cut(
        groups.join(linked, groups["fp"] == linked["node"], "left")
        .select(F.col("fp").alias("own"), F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return prints.join(of_print, prints["fp"] == of_print["own"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def similar_components(
    docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, max_distance: int = WIDE_DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id`` and ``component_id``, the smallest id that links lead to.

    Linked are texts whose sets of word shingles have a Jaccard similarity of at least
    ``percent`` / 100 (exact, on 64-bit hashes), if they are proposed: at first each text with
    the first of all that share one of its least hashes, then all pairs that are not yet in one
    component, have a variant in common, differ at no more than ``max_distance`` bits and have sketches
    that allow it.  So a large group of near copies isn't paired out.  Equal sets (all texts without words, too) are
    one node.  Null ids are linked but name no component.
    """
    least, sketches = [f"least{i}" for i in range(len(FACTORS))], [f"sketch{i}" for i in range(SKETCH_LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        factors = [np.uint64(f) for f in FACTORS]
        for batch in batches:
            found = []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle_words)
                own = np.unique(hashes)
                node = np.uint64(xxh64_intdigest(own.tobytes(), 42)).view(np.int64)
                found.append((_majority(hashes), int(node), len(own), *(int((own * f).min().view(np.int64)) if len(own) else 0 for f in factors), *sketch(own)))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * (3 + len(least) + SKETCH_LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_key", "fp", "node", "n", *least, *sketches])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    prints = cut(narrow.mapInArrow(run, "doc_id long, text_key long, fp long, node long, n long, " + ", ".join(f"{c} long" for c in (*least, *sketches))))
    # Repeated shingles may give equal sets several fingerprints: one of them serves.
    nodes = cut(prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "n", *least, *sketches)], F.min("text_key").alias("text_key"), F.min("doc_id").alias("first_id")))

    keys = nodes.select("node", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("least")) for i, c in enumerate(least)])))
    hubs = cut(keys.groupBy("i", "least").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    spokes = keys.join(hubs, ["i", "least"]).where((F.col("hub.node") != F.col("node")) & _sizes_allow(F.col("n"), F.col("hub.n"), percent))
    first = _similar(spokes.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, narrow, shingle_words, percent)
    roots = cut(components(first))
    named = cut(nodes.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("fp", "node", "n", F.coalesce("root", "node").alias("root"), *sketches))
    release(docs.sparkSession)
    # Each row goes to the join 64 times: 40 bits of the root's hash and the size are one number.
    packed = F.xxhash64("root").bitwiseAND(F.lit(-1 << SIZE_BITS)).bitwiseOR(F.least("n", F.lit((1 << SIZE_BITS) - 1)))
    size = lambda c: F.col(c).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    named = named.select("fp", "node", packed.alias("root_n"), *sketches)
    apart_yet = F.col("a_root_n").bitwiseXOR(F.col("b_root_n")).bitwiseAND(F.lit(-1 << SIZE_BITS)) != 0
    most = (1 << SIZE_BITS) - 1
    sizes = _sizes_allow(size("a_root_n"), size("b_root_n"), percent) | (F.greatest(size("a_root_n"), size("b_root_n")) == most)
    also = (F.col("a_node") < F.col("b_node")) & apart_yet & sizes & _sketches_allow(percent)
    apart = _pairs(named, max_distance, WIDE_SEGMENTS, also).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    more = _similar(apart, nodes, narrow, shingle_words, percent)
    release(docs.sparkSession)

    roots = cut(components(first.unionByName(more)))
    owned = cut(roots.join(nodes, "node").groupBy("root").agg(F.min("first_id").alias("component_id")))
    linked = cut(roots.join(owned, "root").select(F.col("node").alias("member"), "component_id"))
    of_node = cut(nodes.join(linked, F.col("node") == F.col("member"), "left").select(F.col("node").alias("own"), F.coalesce("component_id", "first_id").alias("component_id")))
    return prints.join(of_node, F.col("node") == F.col("own")).select("doc_id", "component_id")


def _sizes_allow(n, m, percent: int):
    """Whether sets of these sizes can be so similar."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _similar(pairs: DataFrame, nodes: DataFrame, narrow: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose shingle sets are so similar; only their texts are
    hashed again."""
    pairs = cut(pairs)
    release(pairs.sparkSession)
    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "text_key"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.unique(shingle_hashes(batch.column(1)[i].as_py(), shingle_words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own], pa.list_(pa.int64()))], ["node", "own"])

    texts = narrow.join(wanted, "text_key").groupBy("node").agg(F.min("text").alias("text"))
    sets = cut(texts.mapInArrow(run, "node long, own array<long>"))
    one, two = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(one, "a").join(two, "b").where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b"))


def keep_similar(docs: DataFrame, **options) -> DataFrame:
    """As ``keep_one``, of the components of ``similar_components`` (with its ``options``)."""
    return _kept(docs, similar_components(docs, **options), options)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate component.

    Of rows that repeat an id and a text one stays; rows with a null id stay.  ``options`` are
    those of ``near_duplicates``.
    """
    return _kept(docs, near_duplicates(docs, **options), options)


def _kept(docs: DataFrame, found: DataFrame, options: dict) -> DataFrame:
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # The document's own columns travel as one, so that none clashes with the names used here.
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("version"))
    named = own.where("id IS NOT NULL").join(kept, F.col("id") == F.col("kept"), "left_semi")
    return named.dropDuplicates(["id", "version"]).select("row.*").unionByName(own.where("id IS NULL").select("row.*"))
