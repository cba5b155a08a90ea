"""SentencePiece encoding and decoding through tables of distinct marked words.

A normalised text is a sequence of chunks, each a run of white-space markers and the run of
other characters after it.  When no piece of the vocabulary has a marker behind another
character (``chunks_are_independent`` checks the model), no merge can join two chunks, so a
distinct chunk is segmented once and its ids are joined back by position.

A task takes its texts in blocks of bounded size.  A block has a table of its distinct chunks, a
text is the numbers of its chunks there, in order; the table is segmented once and the ids of
all texts are gathered by those numbers.  No text and no chunk crosses the network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of a block's texts, about; a longer text is a block of its own.
BLOCK_CHARS = 16_000_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_MODELS: dict[str, tuple] = {}


def chunks_are_independent(processor) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(
        MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size())
    )


def load(model_path: str) -> tuple:
    """The processor and whether chunks can be used."""
    if model_path not in _MODELS:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        probe = processor.encode("  a  B  c ", out_type=str)
        plain = "".join(probe) == f"{MARK}{MARK}{MARK}a{MARK}{MARK}B{MARK} c{MARK}"
        _MODELS[model_path] = (processor, plain and chunks_are_independent(processor))
    return _MODELS[model_path]


def chunks(text: str | None, independent: bool = True) -> list[str]:
    """The chunks of a text as the library takes them in, without the first marker (the whole text
    where they are not independent); an empty or null text has none."""
    if not text:
        return []
    if not independent:
        return [text]
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class _Numbers(dict):
    """Numbers of chunks in the order of their first use."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


def segmented(processor, words: list[str], slice_words: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks, one after the other, and how many each has (without begin and end ids)."""
    marker = [processor.piece_to_id(MARK)]  # the library adds none to an empty text
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), slice_words):
        part = words[at : at + slice_words]
        ids = [own if w else marker for w, own in zip(part, processor.encode(part, num_threads=1), strict=True)]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
    return np.concatenate(flat), np.concatenate(sizes)


def encode_decode(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_text: bool = True,
    block_chars: int = BLOCK_CHARS,
    use_chunks: bool = True,
) -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per input row: ``doc_id`` and ``n_tokens`` (begin and end ids counted),
    ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``
    (UTF-8 of the decoded text), both lower-case hex; with ``with_ids`` the ids themselves
    (``ids``) and with ``with_text`` the decoded text (``decoded``).

    A null text counts as the empty text: two ids, decoded to the empty text.  Null ids are
    passed on, repeated rows stay repeated, an empty table gives an empty table, and other
    columns are not read.  Texts of any length are encoded whole.  Where a model's pieces cross
    markers (or without ``use_chunks``), a whole text is one chunk: the results are the same.
    """
    fields = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>"] * with_ids + ["decoded string"] * with_text
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(f.split()[0], arrow[f.split()[1]]) for f in fields])

    def joined(numbers: _Numbers, texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The results of a block: its texts, as ids and chunk numbers, and its chunks."""
        processor = load(model_path)[0]
        flat, sizes = segmented(processor, list(numbers))
        starts = np.cumsum(sizes) - sizes
        ends = [processor.bos_id()], [processor.eos_id()]
        out, held = [], 0
        for doc_id, codes in texts:
            n = sizes[codes]
            at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids = np.concatenate([ends[0], flat[at], ends[1]]).astype("<u4")
            decoded = processor.decode(ids.tolist())
            row = (doc_id, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            out.append((*row, *[ids.view(np.int32)] * with_ids, *[decoded] * with_text))
            held += len(ids)
            if held > 500_000:  # what leaves for Spark at once is bounded in bytes too
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        independent = load(model_path)[1] and use_chunks
        numbers, texts, size = _Numbers(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                own = chunks(text, independent)
                texts.append((doc_id, np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))))
                size += len(text)
                if size >= block_chars:
                    yield from joined(numbers, texts)
                    numbers, texts, size = _Numbers(), [], 0
        if texts:
            yield from joined(numbers, texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, ", ".join(fields))
