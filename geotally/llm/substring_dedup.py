"""Removal of long repeated passages by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so it is the corpus itself
and has no size bound; an automaton of all of it can't be broadcast, and streaming every
document past every shard would be quadratic.  So the reference is cut to shards that each
document needs: a first search, complete but only by hashes, names for every window of a
document the smallest other document that may hold it, and the automaton of that document is
dealt to the tasks that stream the passages it may repeat.  What is removed are the maximal
spans of the matching statistics.

The search for windows moves little: a window's anchor (see ``passages.Anchors``) must be
shared before its windows are looked at, shared anchors whose surroundings are all alike
stand for all their windows, and only the others are looked up window by window.  Which
anchors and documents matter is broadcast as bitmaps, sized by their number up to a bound;
they may let too much through and never too little.  A reference that very many passages repeat
is dealt to several shards.

Words, anchors and windows are compared by hashes of 64 bits.  Two different windows have one
hash with odds of 2^-64: about n * n / 2^65 pairs among n windows, so none is to be expected in
a corpus of 10^9 words.  Such a pair can only hide a window's true reference (the automaton
then finds nothing and the words stay); it removes nothing that isn't repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotally.llm.bytewords import slices
from geotally.llm.common import cut, written
from geotally.llm.passages import Anchors, SuffixAutomaton, runs

#: Bits of a broadcast bitmap, as powers of two: 32 or more for each hash, from 512 KB to 128 MB.
#: Beyond 2^26 hashes more and more that isn't shared is let through.
BITMAP = (22, 30)
#: Bytes of texts that leave a task at once, about.
BATCH_BYTES = 4 << 20
#: Words and number of repeated passages that one shard streams, about.
SHARD_WORDS, SHARD_PASSAGES = 50_000, 100
#: Rows of a batch that are Python objects at a time.
ROWS = 128


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the lower bits of a column of hashes (an anchor is a least hash, so its upper bits
    are nearly always the same).  At most one row for each of its words is collected."""
    bits = min(max((32 * hashes.count()).bit_length(), BITMAP[0]), BITMAP[1])
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        hashes.select(F.shiftright(at, 6).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor``, ``context`` and ``doc_id``, once for each run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in slices(batch.column(2)):
                a = Anchors(w, window, gram)
                _, text, start, _ = runs(a.context, a.text, a.start, a.count)
                kept = np.isin(a.text * (1 << 40) + a.start, text * (1 << 40) + start, assume_unique=True)
                yield _batch(["anchor", "context", "doc_id"], [a.anchor[kept], a.context[kept], ids[a.text[kept] + w.first]])

    return rows.mapInArrow(run, "anchor long, context long, doc_id long")


def _windows(rows: DataFrame, shared, several, window: int, gram: int) -> DataFrame:
    """``key``, ``doc_id``, ``version``, ``start`` and ``count``: windows that may be repeated.

    A key is the context of a shared anchor, or a window's own hash where contexts differ.
    """
    names = ["key", "doc_id", "version", "start", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in slices(batch.column(2)):
                a = Anchors(w, window, gram)
                wide = _has(several.value, a.anchor)
                whole = _has(shared.value, a.anchor) & ~wide
                n = a.count[wide]
                at = np.repeat(a.at[wide] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
                text = np.repeat(a.text[wide], n)
                parts = [
                    runs(a.context[whole], a.text[whole], a.start[whole], a.count[whole]),
                    runs(a.windows[at], text, at - w.bounds[text], np.ones(len(at), np.int64)),
                ]
                key, text, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield _batch(names, [key, ids[text + w.first], versions[text + w.first], start.astype(np.int32), count.astype(np.int32)])

    return rows.mapInArrow(run, "key long, doc_id long, version long, start int, count int")


SPAN = "doc_id long, version long, ref_id long, start int, stop int"


def _spans(claims: DataFrame, window: int) -> DataFrame:
    """Runs of words whose windows, one after the other, may be in one reference document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = pc.list_parent_indices(lists).to_numpy()
            start, count, ref = (lists.flatten().field(k).to_numpy() for k in ("start", "count", "ref_id"))
            order = np.lexsort((start, ref, row))
            row, start, count, ref = (x[order] for x in (row, start, count, ref))
            stop = start + count
            if not len(row):
                continue
            # Windows of repeated rows may overlap: the furthest stop so far within a group.
            same = np.concatenate([[False], (row[1:] == row[:-1]) & (ref[1:] == ref[:-1])])
            group = np.cumsum(~same)
            far = np.maximum.accumulate(stop + group * (1 << 32)) - group * (1 << 32)
            new = ~same | (start > np.concatenate([[0], far[:-1]]))
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(row) - 1]])
            ids, versions = batch.column(0).to_numpy()[row[first]], batch.column(1).to_numpy()[row[first]]
            yield _batch([f.split()[0] for f in SPAN.split(", ")], [ids, versions, ref[first], start[first].astype(np.int32), (far[last] + window - 1).astype(np.int32)])

    lists = claims.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "count", "ref_id")).alias("found"))
    return lists.mapInArrow(run, SPAN)


def _marked(rows: DataFrame, bitmap) -> DataFrame:
    """The rows whose ``id_hash`` may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(bitmap.value, batch.column("id_hash").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _words(text: str) -> np.ndarray:
    parts = [w.hashes() for w in slices(pa.array([text], pa.large_string()))]
    return parts[0] if parts else np.zeros(0, np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(0, batch.num_rows, ROWS):
        yield from batch.slice(i, ROWS).to_pylist()


SHARD = "ref_id long, shard int, shards int, kind int, doc_id long, version long, start int, text string"


def _passages(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of shards: a reference (kind 0) once for each of its shards, and passages (kind 1)."""
    names = [f.split()[0] for f in SHARD.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in SHARD.split(", ")]

    def found(row: dict) -> Iterator[tuple]:
        whole = row["text"].encode().split()
        if row["shards"]:
            yield row["doc_id"], 0, row["shards"], 0, None, row["version"], 0, b" ".join(whole).decode()
        for p in row["parts"] or []:
            if p["version"] == row["version"]:
                yield p["ref_id"], p["shard"], 0, 1, row["doc_id"], row["version"], p["start"], b" ".join(whole[p["start"] : p["stop"]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in _rows(batch):
                for part in found(row):
                    out.append(part)
                    size += len(part[-1])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = texts.join(asked, texts["doc_id"] == asked["of_id"])
    rows = joined.select("doc_id", "version", "text", "shards", "parts").mapInArrow(run, SHARD)
    # A reference's copies are made by Spark, row by row, and not held together.
    shards = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array("shard"))
    return rows.select("ref_id", F.explode(shards).alias("shard"), "kind", "doc_id", "version", "start", "text")


def _verified(shards: DataFrame, threshold: int) -> DataFrame:
    """Spans of each passage's matching statistics against its reference's automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, automaton = None, None
        words: list = []  # of the reference; rows that repeat its id are apart by a word of their own
        for batch in batches:
            out: list[tuple] = []
            for row in _rows(batch):
                if row["kind"] == 0:
                    if row["ref_id"] != owner or automaton is not None:
                        owner, automaton, words = row["ref_id"], None, []
                    words += [*_words(row["text"]).tolist(), ("end", len(words))]
                elif row["ref_id"] == owner:
                    if automaton is None:
                        automaton = SuffixAutomaton(words)
                    out += [(row["doc_id"], row["version"], row["start"] + a, row["start"] + b) for a, b in automaton.spans(_words(row["text"]).tolist(), threshold)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "version", "start", "stop"])

    dealt = shards.repartition("ref_id", "shard").sortWithinPartitions("ref_id", "shard", "kind", "doc_id", "version", "start")
    return dealt.mapInArrow(run, "doc_id long, version long, start int, stop int")


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(rows: DataFrame, with_text: bool, apart=None) -> DataFrame:
    """The result for rows of ``doc_id``, ``text`` and ``gone`` (spans of removed words), or of
    ``doc_id``, ``text`` and ``id_hash``, of which those in the bitmap ``apart`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")] + ["text"] * with_text
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            spans = batch.column(2)
            if apart is not None:
                batch = batch.filter(pa.array(~_has(apart.value, spans.to_numpy())))
                spans = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            for text, gone in zip(batch.column(1), spans, strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if gone.is_valid and len(gone):
                    flags = np.ones(len(words), bool)
                    for span in gone.as_py():
                        flags[span["start"] : span["stop"]] = False
                    kept = [words[i] for i in np.flatnonzero(flags)]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_texts.append(joined.decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept_texts, pa.string())] * with_text, names)

    return rows.select("doc_id", "text", "id_hash" if apart is not None else "gone").mapInArrow(run, OUT + ", text string" * with_text)


def remove_repeats(
    docs: DataFrame, *, window: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts in a document with
    a smaller id too.  Windows are judged on the input.

    Returns one row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of
    the kept words, joined by one blank), and with ``with_text`` the kept ``text``.  Words are
    runs without the six ASCII spaces.  A null text has no words.  A row with a null id is
    no reference and loses nothing.  Rows that repeat an id are no references of each other;
    each is treated as it is.  Texts shorter than a window keep all; an empty table gives an
    empty table; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    usable = texts.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "version", "text")
    anchors = cut(
        _anchors(usable, window, gram).groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("context").alias("one"), F.max("context").alias("other"))
        .where("least < most").select("anchor", (F.col("one") < F.col("other")).alias("several"))
    )
    shared = context.broadcast(_bitmap(anchors, "anchor"))
    several = context.broadcast(_bitmap(anchors.where("several"), "anchor"))

    windows = written(_windows(usable, shared, several, window, gram), "windows")
    first = cut(
        windows.groupBy("key").agg(F.min("doc_id").alias("ref_id"), F.max("doc_id").alias("most"))
        .where("ref_id < most").select(F.col("key").alias("of_key"), "ref_id")
    )
    claims = windows.join(first, F.col("key") == F.col("of_key")).where("doc_id > ref_id")
    spans = cut(_spans(claims.select("doc_id", "version", "start", "count", "ref_id"), window))

    loads = cut(
        spans.groupBy("ref_id").agg(F.sum(F.col("stop") - F.col("start")).alias("words"), F.count("*").alias("n"))
        .select(F.col("ref_id").alias("of_ref"), F.ceil(F.greatest(F.col("words") / SHARD_WORDS, F.col("n") / SHARD_PASSAGES)).cast("int").alias("shards"))
    )
    parts = (
        spans.join(loads, F.col("ref_id") == F.col("of_ref"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("shards")).cast("int"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("version", "ref_id", "shard", "start", "stop")).alias("parts"))
    )
    asked = cut(
        parts.select(F.col("doc_id").alias("of_id"), "parts").join(loads.select(F.col("of_ref").alias("of_id"), "shards"), "of_id", "full")
    )
    hashed = texts.withColumn("id_hash", F.xxhash64("doc_id"))
    wanted = context.broadcast(_bitmap(asked.select(F.xxhash64("of_id").alias("h")), "h"))
    involved = _marked(hashed.where("doc_id IS NOT NULL AND text IS NOT NULL"), wanted)
    gone = cut(
        _verified(_passages(involved, asked), window)
        .groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("gone"))
        .select(F.col("doc_id").alias("of_id"), F.col("version").alias("of_version"), "gone")
    )
    cleared = context.broadcast(_bitmap(gone.select(F.xxhash64("of_id").alias("h")), "h"))
    return _finish(hashed, gone, cleared, with_text)


def _finish(hashed: DataFrame, gone: DataFrame, cleared, with_text: bool) -> DataFrame:
    """Rows that lose words are dealt to what they lose; all others stay where they are."""

    changed = _marked(hashed, cleared).join(gone, (F.col("doc_id") == F.col("of_id")) & (F.col("version") == F.col("of_version")), "left")
    return _kept(changed, with_text).unionByName(_kept(hashed, with_text, apart=cleared))
