"""Prefix trie of rebuilt conversations by composable fingerprints.

A turn is an element t of two residue rings, a sequence of turns a pair (B^n, sum of t_i B^i): pairs
compose as (x, s)(y, u) = (x y, s + x u), so the fingerprint of a conversation that is put together from
the head of one and the rest of another one is arithmetic on three stored prefixes, and no rebuilt
text is ever made.  Rows of a rebuilt conversation hold its depth, the fingerprint, that of the prefix
one turn shorter, and a reference to the stored turn that was added.

Equal fingerprints of one depth make a node.  They are verified: all members of a node must have
parents of one fingerprint, and the turns that their references name must be equal (only references
that differ are read).  By induction on the depth the nodes are then exact; if any isn't, all is
done again with other bases.

Turns are ordered by ranges, not by conversation: a task composes what it has of each conversation,
and the products of the tasks before are composed onto it, so a conversation of any length is dealt
to many tasks.  What is summed over a subtree needs no pairs of nodes either: a node belongs to its
smallest member, which then owns all its deeper nodes, so words that are saved, leaves and
children of a node are sums over its members of numbers that each conversation has once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotally.llm.bytewords import slices
from geotally.llm.common import cut, written

#: Two primes under 2^31: products stay within 63 bits.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
#: Conversations of one block share the head of its first; a head has fewer turns than the second number.
BLOCK, HEADS = 20, 4
#: References up to so many go to the stored turns as a broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 1 << 20


def bases(seed: int, moduli=MODULI) -> list[int]:
    """A base for each modulus, from a seed."""
    digests = (hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(len(moduli)))
    return [2 + int.from_bytes(d[:8], "little") % (p - 3) for d, p in zip(digests, moduli, strict=True)]


def head_length(conv_id: Column) -> Column:
    """Number of turns that a conversation takes from the first of its block: crc32 of the decimal id, modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _power(base: int, exponent: Column, p: int) -> Column:
    """base ** exponent modulo p for exponents under 2^32, by the exponent's bits."""
    out, factor = F.lit(1).cast("long"), base % p
    for bit in range(32):
        out = (out * F.when(exponent.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(factor)).otherwise(F.lit(1)).cast("long")) % p
        factor = factor * factor % p
    return out


def stored_turns(turns: DataFrame, seed: int, moduli=MODULI, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Written turns with what a task composed of each conversation: ``conv_id``, ``part`` (task), ``at`` (number
    within the task's turns of the conversation, from 1), ``a1``, ``a2`` (composed with this turn), ``e1``,
    ``e2`` (without it), ``words`` and ``before`` (words with and without it), ``role``, ``text``.

    Turns of a conversation are ordered by turn (null first), role and text; null roles and texts
    are empty.  Rows without a conversation take no part.
    """
    row = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    own_bases = bases(seed, moduli)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        part = TaskContext.get().partitionId()
        powers = [np.ones(1, np.int64) for _ in moduli]
        open_conv, last = None, [0] * (2 + len(moduli))  # number, words and sums so far of the conversation at hand
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(2)
            digests = [xxh3_128_intdigest(f"{len(r)}:{r}{t}".encode(), seed) for r, t in zip(batch.column(1).to_pylist(), texts.to_pylist(), strict=True)]
            counts = np.concatenate([np.diff(w.bounds) for w in slices(texts)])
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            begins = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            goes_on = open_conv is not None and conv[0] == open_conv
            carry = last if goes_on else [0] * len(last)

            def summed(values: np.ndarray, start: int, begins=begins, group=group) -> np.ndarray:
                """Sums up to each row within its conversation; the first goes on from ``start``."""
                whole = np.cumsum(values)
                out = whole - (whole[begins] - values[begins])[group]
                return np.where(group == 0, out + start, out)

            at = summed(np.ones(n, np.int64), carry[0])
            words = summed(counts.astype(np.int64), carry[1])
            columns, ends = [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at)], [int(at[-1]), int(words[-1])]
            own = []
            for i, (p, b) in enumerate(zip(moduli, own_bases, strict=True)):
                while len(powers[i]) <= at.max():
                    powers[i] = np.concatenate([powers[i], powers[i] * pow(b, len(powers[i]), p) % p])
                t = np.array([(d >> (64 * i)) % (1 << 64) % p for d in digests], np.int64) * powers[i][at] % p
                s = summed(t, carry[2 + i]) % p
                own.append((s, (s - t) % p))
                ends.append(int(s[-1]))
            columns += [pa.array(x) for pair in zip(*own, strict=True) for x in pair]
            columns += [pa.array(words), pa.array(words - counts), batch.column(1), texts]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "at", "a1", "a2", "e1", "e2", "words", "before", "role", "text"])
            open_conv, last = conv[-1], ends

    dealt = row.where("conv_id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    longs = ", ".join(f"{c} bigint" for c in ("at", "a1", "a2", "e1", "e2", "words", "before"))
    return written(dealt.mapInArrow(run, f"conv_id bigint, part int, {longs}, role string, text string"), "turns")


def _composed(stored: DataFrame, seed: int, moduli) -> tuple[DataFrame, DataFrame]:
    """Segments (``conv_id``, ``part``) with the number of turns and words before and the product of the
    parts before; and conversations with length, words and the prefixes of their first turns."""
    own = bases(seed, moduli)
    last = F.max_by(F.struct("a1", "a2", "words"), "at")
    parts = stored.groupBy("conv_id", "part").agg(F.max("at").alias("n"), last.alias("last"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that has some of it
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = parts.select("conv_id", "part", "n", "last", zero("n").alias("turns_before"), zero("last.words").alias("words_before"))
    placed = placed.select("*", *[_power(b, F.col("turns_before"), p).alias(f"x{i}") for i, (b, p) in enumerate(zip(own, moduli, strict=True), 1)])
    carried = [(zero(F.col(f"last.a{i}") * F.col(f"x{i}") % p) % p).alias(f"c{i}") for i, p in enumerate(moduli, 1)]
    segments = cut(placed.select("conv_id", "part", "n", "turns_before", "words_before", "x1", "x2", *carried))

    first = stored.where(F.col("at") < HEADS).select("conv_id", "part", "at", "a1", "a2", "words").join(segments.where(F.col("turns_before") < HEADS - 1), ["conv_id", "part"])
    prefix = F.struct(*[((F.col(f"c{i}") + F.col(f"a{i}") * F.col(f"x{i}")) % p).alias(f"s{i}") for i, p in enumerate(moduli, 1)], (F.col("words_before") + F.col("words")).alias("w"))
    place = F.col("turns_before") + F.col("at")
    none = F.struct(F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.lit(0).cast("long").alias("w"))
    heads = first.groupBy("conv_id").agg(F.array(none, *[F.max(F.when(place == k, prefix)) for k in range(1, HEADS)]).alias("heads"))
    sizes = segments.groupBy("conv_id").agg(F.sum("n").alias("length"))
    return segments, cut(sizes.join(heads, "conv_id"))


def _rebuilt(stored: DataFrame, segments: DataFrame, convs: DataFrame, seed: int, moduli) -> tuple[DataFrame, DataFrame]:
    """Written rows of all rebuilt conversations (``conv``, ``depth`` from 1, ``length``, fingerprint ``fp``,
    that of the prefix before ``parent_fp``, the turn's reference ``source`` and ``place``, ``words`` and
    ``before``), and conversations with their rebuilt length."""
    base = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"), F.col("heads").alias("base_heads"))
    h = head_length(F.col("conv_id"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "base", "left")
    taken = joined.select("*", F.least(h, F.coalesce("base_length", F.lit(0))).cast("int").alias("head"), F.least(h, F.col("length")).cast("int").alias("skip"))
    none = F.get("heads", 0)
    # B ** (head - skip): what moves the own turns to their places behind the head.
    shifts = [F.array(*[F.lit(pow(b, k, p)).cast("long") for k in range(1 - HEADS, HEADS)]) for b, p in zip(bases(seed, moduli), moduli, strict=True)]
    plan = cut(
        taken.select(
            F.col("conv_id").alias("conv"), "base", "head", "skip", (F.col("head") + F.col("length") - F.col("skip")).alias("rebuilt_length"),
            F.slice(F.coalesce("base_heads", F.array(none)), 1, F.col("head") + 1).alias("prefixes"), F.get("heads", F.col("skip")).alias("skipped"),
            *[F.get(s, F.col("head") - F.col("skip") + HEADS - 1).alias(f"shift{i}") for i, s in enumerate(shifts, 1)],
        )
    )
    as_one = lambda s1, s2: F.shiftleft(s1, 31).bitwiseOR(s2)
    at = F.posexplode(F.slice("prefixes", 2, F.col("head"))).alias("i", "now")
    heads = plan.where("head > 0").select("conv", "base", "rebuilt_length", "prefixes", at).select(
        "conv", (F.col("i") + 1).cast("long").alias("depth"), F.col("rebuilt_length").alias("length"), as_one(F.col("now.s1"), F.col("now.s2")).alias("fp"),
        as_one(F.get("prefixes", F.col("i"))["s1"], F.get("prefixes", F.col("i"))["s2"]).alias("parent_fp"), F.col("base").alias("source"), (F.col("i") + 1).cast("long").alias("place"),
        F.col("now.w").alias("words"), F.get("prefixes", F.col("i"))["w"].alias("before"),
    )
    # A conversation's plan goes to its segments first, so that the join with the turns is by segment.
    dealt = cut(segments.join(plan, segments["conv_id"] == plan["conv"]).where(F.col("turns_before") + F.col("n") > F.col("skip")).drop("conv_id", "base", "n").withColumnRenamed("part", "of_part"))
    narrow = stored.drop("role", "text")
    tails = narrow.join(dealt, (F.col("conv_id") == F.col("conv")) & (F.col("part") == F.col("of_part"))).withColumn("place", F.col("turns_before") + F.col("at")).where("place > skip")
    end = F.get("prefixes", F.col("head"))

    def moved(kind: str) -> Column:
        sums = []
        for i, p in enumerate(moduli, 1):
            own = (F.col(f"c{i}") + F.col(f"{kind}{i}") * F.col(f"x{i}")) % p
            sums.append((end[f"s{i}"] + (own + p - F.col(f"skipped.s{i}")) % p * F.col(f"shift{i}")) % p)
        return as_one(*sums)

    counted = lambda c: end["w"] + F.col("words_before") + F.col(c) - F.col("skipped.w")
    tails = tails.select(
        "conv", (F.col("head") + F.col("place") - F.col("skip")).alias("depth"), F.col("rebuilt_length").alias("length"), moved("a").alias("fp"), moved("e").alias("parent_fp"),
        F.col("conv").alias("source"), "place", counted("words").alias("words"), counted("before").alias("before"),
    )
    return written(heads.unionByName(tails), "rebuilt"), plan.select("conv", F.col("rebuilt_length").alias("length"))


def _all_equal(groups: DataFrame, rows: DataFrame, stored: DataFrame, segments: DataFrame) -> bool:
    """Whether every node's members have one parent and equal turns: the stored turns are read by the
    references that differ within a node."""
    if groups.where("least_parent <> most_parent").limit(1).count():
        return False
    mixed = groups.where("least_ref <> most_ref").select(F.col("depth").alias("of_depth"), F.col("fp").alias("of_fp"))
    refs = written(rows.join(mixed, (F.col("depth") == F.col("of_depth")) & (F.col("fp") == F.col("of_fp"))).select("depth", "fp", "source", "place").distinct(), "references")
    placed = refs.join(segments.select(F.col("conv_id").alias("source"), "part", "turns_before", "n"), "source").where("place > turns_before AND place <= turns_before + n")
    wanted = placed.select("depth", "fp", F.col("source").alias("of_conv"), F.col("part").alias("of_part"), (F.col("place") - F.col("turns_before")).alias("of_at"))
    small = refs.count() <= MAX_BROADCAST
    texts = stored.select("conv_id", "part", "at", "role", "text")
    on = (F.col("conv_id") == F.col("of_conv")) & (F.col("part") == F.col("of_part")) & (F.col("at") == F.col("of_at"))
    read = texts.join(F.broadcast(wanted) if small else wanted, on)
    content = F.struct("role", "text")
    return not read.groupBy("depth", "fp").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").limit(1).count()


def nodes(turns: DataFrame, *, attempts=None, **columns: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root (depth 0) included.

    Conversation c is rebuilt from the first h turns of conversation c - c % 20 (see ``head_length``; all
    if fewer, none if that doesn't exist) and its own turns behind its first h (remainders of negative ids are negative); its members are all that
    begin with the node's turns (role and text).  Columns: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (the parent's; root: null), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in the subtree, the node included), ``saved_tokens`` (over the subtree, (n_convs - 1) times
    the words of each node's last text), ``n_ends`` and ``ends_sha256`` (number and digest of the members that
    end here: decimal ids, rising, joined by commas; the ids of a node are streamed through one task, as the
    digest is one sequence).

    Rows without a conversation id take no part; null roles and texts are empty; repeated rows
    are turns of their own; equal turns of a conversation are ordered by role and text.  No conversation at
    all: an empty table.  ``attempts`` are pairs of a seed and moduli, for as long as verification fails.
    """
    for seed, moduli in attempts or ((s, MODULI) for s in range(1, 1 << 30)):
        stored = stored_turns(turns, seed, moduli, **columns)
        segments, heads = _composed(stored, seed, moduli)
        rows, convs = _rebuilt(stored, segments, heads, seed, moduli)
        ref = F.struct("source", "place")
        groups = cut(
            rows.groupBy("depth", "fp").agg(
                F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("length").alias("longest"), F.min("parent_fp").alias("least_parent"), F.max("parent_fp").alias("most_parent"),
                F.min(ref).alias("least_ref"), F.max(ref).alias("most_ref"),
            )
        )
        if _all_equal(groups, rows, stored, segments):
            return _described(rows, convs, groups)
    raise RuntimeError("no attempt told all turns apart")


def _described(rows: DataFrame, convs: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes' columns, from sums over their members."""
    named = groups.select(F.col("depth").alias("of_depth"), F.col("fp").alias("of_fp"), "owner", "longest")
    owned = written(rows.join(named, (F.col("depth") == F.col("of_depth")) & (F.col("fp") == F.col("of_fp"))).select("conv", "depth", "length", "words", "before", "owner", "longest"), "owned")
    root = convs.agg(F.min("conv").alias("root"), F.max("length").alias("most"))  # one row
    others = F.col("owner") < F.col("conv")
    # A conversation owns its nodes from some depth on; what it has before is shared with smaller ids.
    each = owned.groupBy("conv").agg(
        F.min(F.when(~others, F.col("depth"))).alias("owns_from"), F.coalesce(F.max(F.when(others, F.col("words"))), F.lit(0)).alias("shared_words"), F.max(F.when(others, F.col("owner"))).alias("last_other"),
        F.max(F.when(~others & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("length")), 1).otherwise(0)).alias("leaf"),
    )
    own = convs.withColumnRenamed("conv", "member").join(each, F.col("member") == F.col("conv"), "left").crossJoin(F.broadcast(root)).select(
        "member", F.col("length").alias("ends_at"), "owns_from", F.coalesce("shared_words", F.lit(0)).alias("shared_words"), F.coalesce("last_other", "root").alias("last_other"), "root",
        F.when(F.col("most") == 0, (F.col("member") == F.col("root")).cast("int")).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"),
    )
    own = cut(own)
    joined = owned.select("conv", "depth", "before", "owner").join(own, F.col("conv") == F.col("member"))
    tops = own.select(F.col("member").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), F.col("root").alias("owner"), *own.columns)
    both = joined.unionByName(tops)
    child = F.coalesce((F.col("owns_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("ends_at")), F.lit(False))
    parent = F.when(F.col("depth") == 1, F.col("root")).when(F.col("owns_from") < F.col("depth"), F.col("conv")).otherwise(F.col("last_other"))
    sums = both.groupBy("owner", "depth").agg(
        F.max(F.when((F.col("conv") == F.col("owner")) & (F.col("depth") > 0), parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("shared_words") - F.col("before"))).alias("saved_tokens"),
    )
    ended = owned.where("depth = length").select("owner", "depth", "conv").unionByName(own.where("ends_at = 0").select(F.col("root").alias("owner"), F.lit(0).cast("long").alias("depth"), F.col("member").alias("conv")))
    ends = _ends(ended).withColumnsRenamed({"owner": "of_owner", "depth": "of_depth"})
    named = sums.join(ends, (F.col("owner") == F.col("of_owner")) & (F.col("depth") == F.col("of_depth")), "left")
    return named.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _ends(ended: DataFrame) -> DataFrame:
    """``owner``, ``depth``, ``n_ends``, ``ends_sha256``: each node's ids in order go through one running digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        out: list[tuple] = []

        def flush():
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["owner", "depth", "n_ends", "ends_sha256"])

        for batch in batches:
            owner, depth, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])])) if len(conv) else []
            for a, b in zip(begins, [*begins[1:], len(conv)], strict=True):
                now = (int(owner[a]), int(depth[a]))
                ids = ",".join(map(str, conv[a:b].tolist())).encode()
                if now == key:
                    digest.update(b"," + ids)
                    n += int(b - a)
                    continue
                if key is not None:
                    out.append((*key, n, digest.hexdigest()))
                key, digest, n = now, hashlib.sha256(ids), int(b - a)
            if len(out) >= 4096:
                yield flush()
        if key is not None:
            out.append((*key, n, digest.hexdigest()))
        if out:
            yield flush()

    dealt = ended.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv")
    return dealt.mapInArrow(run, "owner bigint, depth bigint, n_ends bigint, ends_sha256 string")
