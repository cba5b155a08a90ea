"""Benchmark decontamination by pigeonhole edit matching.

An item may be found with up to ``budget(len)`` errors.  Cut into one piece more than that, it
has a piece without error wherever it occurs, so an Aho-Corasick pass finds every place to look
at, and Myers' bit-parallel distance verifies the window around it.  Verification climbs a
binary tree over the pieces: of n neighbouring pieces with fewer than n errors, one half has
fewer errors than pieces too, so from a piece without error each larger part must have fewer
errors than pieces, and chance hits end at the first small part.  Short items, which chance would
find within longer words, must begin and end with whole words, with errors or without.

Documents are streamed where they lie; only the items move, in blocks whose size is checked
before they are broadcast, one block at a time.  With several blocks only what is found moves, by
hashes of the texts.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import held, written

#: Errors allowed per character of the item.
ERROR_RATE = 0.10
#: Shorter items (normalised) would be found within other words by chance: they must be whole words.
MIN_ITEM_CHARS = 32
#: Items of a block, in characters: what is broadcast at once.
BLOCK_CHARS = 4_000_000
#: Masks and parts that a worker keeps, in items or pieces.
KEPT = 20_000

LEAKS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


_BETWEEN = re.compile(r"\W+")


def normalise(text: str | None) -> str:
    """Lower case, all between letters, digits and underscores as single blanks."""
    return _BETWEEN.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Errors that an item of this length may be found with."""
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors + 1`` pieces, each with its place in the item."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def climb(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces, the parts (first piece, last + 1) of the tree above it, smallest first."""
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def split(a: int, b: int) -> None:
        if b - a > 1:
            split(a, (a + b) // 2)
            split((a + b) // 2, b)
            for i in range(a, b):
                paths[i].append((a, b))

    split(0, n)
    return paths


def masks(pattern: str) -> dict[str, int]:
    """For each character of the pattern, a bit for each place that has it."""
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def myers(places: dict[str, int], size: int, text: str, *, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and that part's end.

    The part may start anywhere, or at the first character if ``anchored``; of equal distances
    the first end counts.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for j, c in enumerate(text):
        equal = places.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        fall = plus & across
        if up & top:
            score += 1
        elif fall & top:
            score -= 1
        up = up << 1 | anchored
        fall <<= 1
        plus = (fall | ~(down | up)) & full
        minus = up & down & full
        if score < best:
            best, end = score, j + 1
    return best, end


def whole_distance(places: dict[str, int], size: int, text: str) -> int:
    """Edit distance of the pattern to all of ``text``."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for c in text:
        equal = places.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, fall = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(fall & top)
        up, fall = up << 1 | 1, fall << 1
        plus, minus = (fall | ~(down | up)) & full, up & down & full
    return score


class Finder:
    """The pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int = 0) -> None:
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        where: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (_, text, errors) in enumerate(self.items):
            for k, (at, piece) in enumerate(pieces(text, errors)):
                where[piece].append((n, k, at))
        self.parts: dict[tuple[int, int], tuple] = {}  # made when first needed
        self.made: dict[int, tuple[dict, dict]] = {}
        self.machine = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.machine.add_word(piece, (len(piece), hits))
        if where:
            self.machine.make_automaton()
        self.empty = not where

    def _parts(self, n: int, k: int) -> tuple:
        """What to look for above piece k of item n: first quickly, beside the piece (start, length,
        errors, cuts of which one must be there), then the parts but the whole (start, length,
        masks, errors)."""
        if (n, k) not in self.parts:
            if len(self.parts) >= KEPT:
                self.parts.clear()
            _, text, errors = self.items[n]
            starts = [at for at, _ in pieces(text, errors)] + [len(text)]
            above = climb(errors + 1)[k]
            own = [(starts[a], starts[b] - starts[a], masks(text[starts[a] : starts[b]]), b - a - 1) for a, b in above]
            beside = (0, 0, 0, [])
            if len(own) > 1:  # what the first part has besides the piece, cut so that one cut has no error
                a, b = above[0]
                c, d = (starts[a], starts[k]) if k > a else (starts[k + 1], starts[b])
                beside = (c, d - c, b - a - 1, [x for _, x in pieces(text[c:d], b - a - 1)])
            self.parts[n, k] = (beside, own[:-1])
        return self.parts[n, k]

    def _masks(self, n: int) -> tuple[dict, dict]:
        """Masks of item n and of its reverse."""
        if n not in self.made:
            if len(self.made) >= KEPT:
                self.made.clear()
            text = self.items[n][1]
            self.made[n] = masks(text), masks(text[::-1])
        return self.made[n]

    def _may_be(self, clean: str, n: int, k: int, start: int) -> bool:
        """Whether all parts above a piece are near enough where the item would start at ``start``."""
        (at, size, errors, cuts), parts = self._parts(n, k)
        if cuts:
            near = clean[max(start + at - errors, 0) : max(start + at + size + errors, 0)]
            if not any(x in near for x in cuts):
                return False
        for at, size, places, errors in parts:
            a = start + at - errors
            if myers(places, size, clean[max(a, 0) : a + size + 2 * errors])[0] > errors:
                return False
        return True

    def leaks(self, text: str | None) -> list[dict]:
        """Items in the text, each at its best place, in the items' order."""
        if self.empty or not (clean := normalise(text)):
            return []
        hits_at: dict[int, dict[int, set[int]]] = defaultdict(dict)
        for last, (size, hits) in self.machine.iter(clean):
            for n, k, at in hits:
                hits_at[n].setdefault(last + 1 - size - at, set()).add(k)
        found = []
        for n in sorted(hits_at):
            item, pattern, errors = self.items[n]
            size = len(pattern)
            whole_words = size < self.min_chars
            best = None
            for a in sorted(hits_at[n]):
                if a >= 0 and clean.startswith(pattern, a):
                    if whole_words and (clean[a - 1 : a].strip() or clean[a + size : a + size + 1].strip()):
                        continue
                    best = (0, a, a + size)
                    break
            if best is None and whole_words and errors:
                starts = [a for a in sorted(hits_at[n]) if any(self._may_be(clean, n, k, a) for k in hits_at[n][a])]
                best = self._as_words(clean, n, starts)
            elif best is None and errors:
                places, reverse = self._masks(n)
                starts = [a for a in sorted(hits_at[n]) if any(self._may_be(clean, n, k, a) for k in hits_at[n][a])]
                for a, b in self._windows(starts, size, errors):
                    a = max(a, 0)
                    distance, end = myers(places, size, clean[a:b])
                    if distance <= errors and (best is None or distance < best[0]):
                        back = clean[a : a + end][::-1]
                        best = (distance, a + end - myers(reverse, size, back, anchored=True)[1], a + end)
            if best is not None:
                found.append({"item_id": item, "distance": best[0], "start": best[1], "end": best[2]})
        return found

    def _as_words(self, clean: str, n: int, starts: list[int]) -> tuple[int, int, int] | None:
        """Least distance of item n to whole words that begin near one of the places (the first of equally near)."""
        _, pattern, errors = self.items[n]
        size, places = len(pattern), self._masks(n)[0]
        best, tried = None, set()
        for near in starts:
            for a in range(max(0, near - errors), near + errors + 1):
                if a in tried or a >= len(clean) or clean[a] == " " or clean[a - 1 : a].strip():
                    continue
                tried.add(a)
                for b in range(a + size - errors, min(len(clean), a + size + errors) + 1):
                    if clean[b - 1] == " " or clean[b : b + 1].strip():
                        continue
                    distance = whole_distance(places, size, clean[a:b])
                    if distance <= errors and (best is None or distance < best[0]):
                        best = (distance, a, b)
        return best

    @staticmethod
    def _windows(starts: list[int], size: int, errors: int) -> list[list[int]]:
        """Windows around the places, those that overlap nearly wholly as one."""
        out: list[list[int]] = []
        for s in starts:
            a, b = s - errors, s + size + errors
            if out and a - out[-1][0] <= 2 * errors:
                out[-1][1] = b
            else:
                out.append([a, b])
        return out


def item_blocks(
    benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> list[DataFrame]:
    """The items with their normalised text, in as many blocks as their size asks for."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _search(items: list, docs: DataFrame, rate: float, min_chars: int):
    """The search for one block of items, as a function of a text column, and what was broadcast."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(LEAKS)
    def leaks(text: pd.Series) -> pd.Series:
        found = held(name, lambda: Finder(shared.value, rate, min_chars))
        return pd.Series([found.leaks(t) for t in text], dtype=object)

    return leaks.asNondeterministic(), shared  # else the optimiser may run it once for each use


def with_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_ITEM_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with ``leaks``, the benchmark items in the text.

    A leak has the item's id, its edit distance (both texts normalised, so that case, white
    space and punctuation don't count; at most ``rate`` errors a character) and the place in
    the normalised text.  Items shorter than ``min_chars`` are found, with as many errors a character, where
    they begin and end with whole words.
    Of several places of one item the closest counts, then the first looked at.  A null or
    empty text has none; very long texts are searched whole.  Items that are null or have no
    letter, digit or underscore are not looked for; items with a null id or with equal texts
    are reported like any other.  Leaks are in the order of item (null first), distance and place.  Repeated rows stay repeated; an empty table on either side is
    no error; a column named ``leaks`` is replaced.

    A worker holds one block of items (an item larger than a block is a block).  A benchmark of several
    blocks is searched block by block: each pass writes the leaks of the texts that have any, under a
    128-bit hash of the text, and these are joined to the rows at the end.
    """
    blocks = item_blocks(benchmark, block_chars=block_chars)
    columns = [c for c in docs.columns if c != "leaks"]
    if len(blocks) == 1:
        search, _ = _search(_normalised(blocks[0]), docs, rate, min_chars)
        return docs.withColumn("leaks", F.array_sort(search(F.col(text_col))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    parts = None
    for block in blocks:
        search, shared = _search(_normalised(block), docs, rate, min_chars)
        found = written(docs.select(key.alias("of_text"), search(F.col(text_col)).alias("leaks")).where(F.size("leaks") > 0), "leaks")
        shared.unpersist()
        parts = found if parts is None else parts.unionByName(found)
    whole = parts.distinct().groupBy("of_text").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("found"))
    own = docs.select(F.struct(*columns).alias("row"), key.alias("text_key"))
    joined = own.join(whole, F.col("text_key") == F.col("of_text"), "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in columns], F.coalesce("found", F.array().cast(LEAKS)).alias("leaks"))


def _normalised(block: DataFrame) -> list[tuple[int | None, str]]:
    """The items of a block with their normalised texts, by id (null first) and text."""
    items = sorted((r.item_id if r.item_id is not None else -(2**63), r.item_id, t) for r in block.toLocalIterator() if (t := normalise(r.text)))
    return [x[1:] for x in items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns (see ``with_leaks``)."""
    columns = [F.col(c) for c in docs.columns]
    if "leaks" not in docs.columns:
        return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).select(*columns)
    own = docs.select(F.struct(*columns).alias("row"), F.col(options.pop("text_col", "text")).alias("text"))
    return with_leaks(own, benchmark, **options).where(F.size("leaks") == 0).select("row.*")
