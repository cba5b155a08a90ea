"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line.  A section ends with an empty paragraph or with one whose digest begins
with 0 or 1 (one in eight), so that a change moves no boundary but its own.  A paragraph's digest
is the SHA-256 of its text, a section's that of its paragraphs' digests, the root that of the
sections' digests; the levels are marked apart.  Splitting loses nothing, so equal roots mean equal
texts.  Two trees are compared from the top: equal sections are skipped from both ends, then equal
paragraphs in the sections that differ, which locates what was edited.

Below the paragraphs are pieces: up to four words, ended early by a punctuation mark or the end
of a line (words beyond 64 characters are cut).  The likeness of two trees is the share of their
characters in pieces that both have.

All of it is column expressions.  The document that follows another one is found with one shuffle
of the texts: ids are dealt to ranges by approximate quantiles (each bound is an id that exists, so
it is the first of its range), and that first document goes to the range before as a guest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to three words without a mark at their end, then a word; the patterns of Java and of other engines agree on it.
PIECE = r"(?:[^ \n]{0,63}[^ \n.,;:!?] {1,64}){0,3}[^ \n]{0,64} {0,64}\n?"
#: Low bits of a piece's key that hold its length (513 characters at most).
LENGTH_BITS = 10
#: Documents in a range, and the largest number of ranges (their bounds are an array on every task).
RANGE_ROWS, MAX_RANGES = 256, 1 << 16


def _with(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tree(text: Column) -> Column:
    """Struct of a text's tree: ``root`` (64 hex digits), ``sections`` (digests), ``ends`` (paragraphs up to
    the end of each section), ``paragraphs`` (digests) and ``sizes`` (code points).

    A null text is the empty text, which is one section of one empty paragraph.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    empty = F.sha2(F.lit("p:"), 256)

    def grown(ls: Column) -> Column:
        digests = F.transform(ls, lambda x: F.sha2(F.concat(F.lit("p:"), x), 256))
        return _with(F.struct(digests.alias("paragraphs"), F.transform(ls, F.length).alias("sizes")), cut)

    def cut(t: Column) -> Column:
        d = t["paragraphs"]
        last = lambda i: (F.element_at(d, i) < "2") | (F.element_at(d, i) == empty)
        ends = F.array_union(F.filter(F.sequence(F.lit(1), F.size(d)), last), F.array(F.size(d)))
        return _with(F.struct(ends.alias("ends"), d.alias("paragraphs"), t["sizes"].alias("sizes")), crowned)

    def crowned(t: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(t["ends"], 1, F.size(t["ends"]) - 1))
        part = lambda a, b: F.sha2(F.concat(F.lit("s:"), F.array_join(F.slice(t["paragraphs"], a + 1, b - a), "")), 256)
        return _with(F.zip_with(starts, t["ends"], part), lambda s: F.struct(F.sha2(F.concat(F.lit("d:"), F.array_join(s, "")), 256).alias("root"), s.alias("sections"), t["ends"].alias("ends"), t["paragraphs"].alias("paragraphs"), t["sizes"].alias("sizes")))

    return _with(lines, grown)


def _agree(a: Column, b: Column) -> Column:
    """Number of elements that two arrays have in common at their start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return _with(first, lambda i: F.when(i > 0, i - 1).otherwise(F.size(a)).cast("int"))


def changed(own: Column, other: Column) -> Column:
    """Struct ``start``, ``stop``: the code points of a text (tree ``own``) whose paragraphs differ from those
    of another one; null if the roots are equal.

    Sections are compared first, paragraphs only from the first section on that differs.  Both trees should be
    columns of a table (as expressions inside this one they nest deeper than the analyzer goes).
    """

    def common(a: Column, b: Column, last) -> Column:
        """Equal paragraphs at the start of both trees (at their end: of both reversed)."""
        skipped = _agree(last(a["sections"]), last(b["sections"]))

        def inside(k: Column) -> Column:
            done = lambda t: F.when(k == 0, F.lit(0)).otherwise(_before(t, k, last))
            rest = lambda t: F.slice(last(t["paragraphs"]), done(t) + 1, F.size(t["paragraphs"]))
            return done(a) + _agree(rest(a), rest(b))

        return _with(skipped, inside)

    forward, backward = lambda x: x, F.reverse

    def span(f: Column) -> Column:
        back = F.least(common(own, other, backward), F.least(F.size(own["paragraphs"]), F.size(other["paragraphs"])) - f)
        chars = lambda sizes, n: F.aggregate(F.slice(sizes, 1, n), F.lit(0), lambda s, x: s + x + 1)
        whole = F.aggregate(own["sizes"], F.lit(0), lambda s, x: s + x) + F.size(own["sizes"]) - 1
        start = chars(own["sizes"], f)
        stop = whole - chars(F.reverse(own["sizes"]), back)
        return F.struct(F.least(start, whole).cast("long").alias("start"), F.greatest(stop, F.least(start, whole)).cast("long").alias("stop"))

    return F.when(own["root"] != other["root"], _with(common(own, other, forward), span))


def _before(t: Column, k: Column, last) -> Column:
    """Paragraphs in the first (or last) ``k`` sections, one at least."""
    n = F.size(t["ends"])
    if last is F.reverse:
        return F.element_at(t["ends"], -1) - F.when(k < n, F.element_at(t["ends"], n - k)).otherwise(F.lit(0))
    return F.element_at(t["ends"], F.least(k, n))


def pieces(text: Column) -> Column:
    """Keys of a text's distinct pieces: 54 bits of hash, then the length."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: p != "")
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p).bitwiseAND(F.lit(-(1 << LENGTH_BITS))).bitwiseOR(F.length(p).cast("long"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the characters of two texts' distinct pieces that are in pieces of both (0 to 1; two
    texts without pieces: 1)."""
    chars = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, p: s + p.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)))
    whole = lambda s: F.when(s["all"] == 0, F.lit(1.0)).otherwise(F.lit(2.0) * s["both"] / s["all"])
    return _with(F.struct((chars(a) + chars(b)).alias("all"), chars(F.array_intersect(a, b)).alias("both")), whole)


def _range_bounds(ids: DataFrame) -> list[int]:
    """The largest id of each range, rising; every bound is an id of the table."""
    n = ids.count()
    many = min(MAX_RANGES, n // RANGE_ROWS + 1)
    shares = F.from_json(F.lit(json.dumps([i / many for i in range(1, many)] or [0.5])), "array<double>")
    row = ids.agg(F.max("id").alias("top"), F.percentile_approx("id", shares, max(10_000, 4 * many)).alias("bounds")).first()
    return sorted({*(row.bounds or []), row.top} - {None})


def followed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as one), ``id``, ``text``, ``next_text`` and ``pieces``,
    ``next_pieces``: each document with the next one by descending id; after the last comes the first.

    Rows that repeat an id follow each other in the order of their texts.  A row without an id is
    its own successor.  An empty table gives an empty table.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _range_bounds(own.select("id").where("id IS NOT NULL"))
    last = len(bounds) - 1
    uppers = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    # Number of bounds under the id: a binary search, one bit after the other.
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    below = F.aggregate(bits, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(uppers, at + step - 1) < F.col("id"), F.lit(False)), at + step).otherwise(at))
    # Rows without an id need no neighbour: they are spread by their texts.
    ranged = own.withColumn("range", F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(MAX_RANGES)).cast("int")).otherwise(below))
    first = F.get(uppers, F.col("range")) == F.col("id")
    guest_of = F.when(first, F.when(F.col("range") == last, F.lit(0)).otherwise(F.col("range") + 1))
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(guest_of.alias("range"), F.lit(True).alias("guest")))
    dealt = ranged.select("row", "id", "text", F.inline(F.filter(places, lambda p: p["range"].isNotNull()))).repartition("range")
    cut = dealt.select("row", "id", "text", "range", "guest", pieces(F.col("text")).alias("pieces"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("id"), "text")
    after = cut.select("*", F.lead("text").over(order).alias("__text"), F.lead("pieces").over(order).alias("__pieces")).where("NOT guest")
    return after.select("row", "id", "text", F.when(F.col("id").isNull(), F.col("text")).otherwise(F.col("__text")).alias("next_text"), "pieces", F.when(F.col("id").isNull(), F.col("pieces")).otherwise(F.col("__pieces")).alias("next_pieces"))


def with_tail(text: Column, next_text: Column) -> Column:
    """A text whose last half (rounded down) is replaced by as many code points from the start of another one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(next_text, half))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``fingerprint`` (the root), ``n_sections``, ``n_paragraphs`` (long);
    columns of those names in the input are replaced.  No shuffle."""
    new = ("fingerprint", "n_sections", "n_paragraphs")
    columns = [c for c in docs.columns if c not in new]
    grown = docs.select(F.struct(*columns).alias("row"), tree(F.col(text_col)).alias("tree"))
    return grown.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("tree.root").alias("fingerprint"), F.size("tree.sections").cast("long").alias("n_sections"), F.size("tree.paragraphs").cast("long").alias("n_paragraphs"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_chars``, ``edited_text`` (see ``with_tail``, with the next
    document), ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, and
    ``changed_from``, ``changed_to``: the code points of the text that the trees' differing branches
    cover (null if the edit changes nothing).

    A null text is empty: it has no half to replace, so it is like its edited text (1), and like
    the next one only if that is empty too.  Repeated rows are kept.  An empty table gives an empty
    table.
    """
    both = followed(docs, id_col=id_col, text_col=text_col).withColumn("edited", with_tail(F.col("text"), F.col("next_text")))
    grown = both.select("id", "text", "edited", "pieces", "next_pieces", pieces(F.col("edited")).alias("edited_pieces"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("other"))
    found = grown.select("*", likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"), changed(F.col("own"), F.col("other")).alias("changed"))
    return found.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.col("edited").alias("edited_text"), F.col("own.root").alias("fingerprint"),
        F.col("other.root").alias("edited_fingerprint"), "near_edited", "near_next", F.col("changed.start").alias("changed_from"), F.col("changed.stop").alias("changed_to"),
    )
