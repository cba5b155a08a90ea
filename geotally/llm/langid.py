"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability
of a word is the sum over all its segmentations into pieces, by a forward pass over its
letters; that of a text is the product over its words.  The pieces' expected counts under all
segmentations (pieces alike at first) are gathered over all training rows, in fixed-point
numbers, so that their sums don't depend on the order.

The lattices of many words of one length are worked on at once, and a worker keeps the scores
of the words it has seen in a table of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import held, written

MARK = "▁"
#: Words up to this length are worked on together and kept in tables; longer ones one by one.
MAX_LETTERS = 32
#: Languages of one model, which is collected and broadcast (17 MB); more languages are several models, one pass each.
MAX_LANGUAGES = 64
#: Fixed-point unit of expected counts.
UNIT = 1 << 16
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Numbers other than decimal digits (a half, a circled one) are no letters.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _codes(batch: list[str]) -> np.ndarray:
    """Code points of words of one length, the marker before them."""
    return np.frombuffer("".join(MARK + w for w in batch).encode("utf-32-le"), np.uint32).reshape(len(batch), -1).astype(np.uint64)


class Vocabulary:
    """Lookup of pieces in many words at once, by rolling hashes verified against a table."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        kept = []
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            letters = piece.removeprefix(MARK).lower()
            plain = not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))
            if plain and (letters.isalpha() or piece == MARK):
                kept.append(MARK * piece.startswith(MARK) + letters)
        self.pieces = sorted(set(kept))
        self.size = len(self.pieces)
        by_length: dict[int, list[int]] = {}
        for n, piece in enumerate(self.pieces):
            by_length.setdefault(len(piece), []).append(n)
        self.tables = {}
        for length, ids in sorted(by_length.items()):
            keys = np.zeros(len(ids), np.uint64)
            for c in np.array([[ord(x) for x in self.pieces[i]] for i in ids], np.uint64).T:
                keys = (keys + c) * _BASE
            order = np.argsort(keys)
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.tables[length] = (keys[order], np.array(ids, np.int64)[order], seen)
        self.longest = max(by_length)

    def _matches(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, words, starts and numbers of all pieces in words of one length, by rising length."""
        n, width = codes.shape
        hashes = np.zeros((n, width), np.uint64)
        for length in range(1, min(width, self.longest) + 1):
            # hashes[:, j]: of the letters j .. j + length - 1
            hashes = (hashes[:, : width - length + 1] + codes[:, length - 1 :]) * _BASE
            if length not in self.tables:
                continue
            keys, ids, seen = self.tables[length]
            at, start = np.nonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
            h = hashes[at, start]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            yield length, at[hit], start[hit], ids[place[hit]]

    def lattice(self, word: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each end in one word: the starts and the numbers of the pieces that end there."""
        codes = _codes([word])
        width = codes.shape[1]
        parts = [(start + length, start, piece) for length, _, start, piece in self._matches(codes)]
        end, start, piece = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        single = np.setdiff1d(np.arange(1, width + 1), end[end - start == 1])
        end, start, piece = np.concatenate([end, single]), np.concatenate([start, single - 1]), np.concatenate([piece, np.full(len(single), self.size)])
        order = np.lexsort((start, end))
        cuts = np.searchsorted(end[order], np.arange(1, width + 2))
        return [(start[order[a:b]], piece[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def arcs(self, batch: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of all pieces in words of one length, by rising end."""
        codes = _codes(batch)
        n, width = codes.shape
        out = []
        found: dict[int, list] = {}
        for length, at, start, piece in self._matches(codes):
            for s in range(width - length + 1):
                own = start == s
                if own.any():
                    found.setdefault(s + length, []).append((s, s + length, at[own], piece[own]))
        for end in range(1, width + 1):
            have = {s for s, _, _, _ in found.get(end, [])}
            for arc in found.get(end, []):
                out.append(arc)
            single = np.ones(n, bool)  # a letter outside the vocabulary is a piece of its own
            for s, _, at, _ in found.get(end, []):
                if s == end - 1:
                    single[at] = False
            if end - 1 not in have or single.any():
                at = np.flatnonzero(single)
                out.append((end - 1, end, at, np.full(len(at), self.size, np.int64)))
        return out


def expected_counts(vocabulary: Vocabulary, batch: list[str], times: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of words of one length, pieces alike."""
    arcs, n, width = vocabulary.arcs(batch), len(batch), len(batch[0]) + 1
    p = 1.0 / vocabulary.size
    forward = np.zeros((width + 1, n))
    backward = np.zeros((width + 1, n))
    forward[0] = backward[width] = 1.0
    for s, e, at, _ in arcs:
        forward[e, at] += forward[s, at] * p
    for s, e, at, _ in reversed(arcs):
        backward[s, at] += backward[e, at] * p
    scale = times / forward[width]
    total = np.zeros(vocabulary.size + 1)
    for s, e, at, piece in arcs:
        total += np.bincount(piece, forward[s, at] * backward[e, at] * p * scale[at], vocabulary.size + 1)
    return total


def log_scores(vocabulary: Vocabulary, batch: list[str], probability: np.ndarray) -> np.ndarray:
    """Log-probability of words of one length in each language, all segmentations summed."""
    n, width = len(batch), len(batch[0]) + 1
    forward = np.zeros((width + 1, n, probability.shape[1]))
    forward[0] = 1.0
    for s, e, at, piece in vocabulary.arcs(batch):
        forward[e, at] += forward[s, at] * probability[piece]
    return np.log(forward[width])


def long_counts(vocabulary: Vocabulary, word: str, times: float) -> np.ndarray:
    """``expected_counts`` of one word of any length, in logarithms."""
    ends, p = vocabulary.lattice(word), -np.log(vocabulary.size)
    forward = np.zeros(len(ends) + 1)
    for e, (starts, _) in enumerate(ends, 1):
        forward[e] = np.logaddexp.reduce(forward[starts] + p)
    backward = np.full(len(ends) + 1, -np.inf)
    backward[-1] = 0.0
    total = np.zeros(vocabulary.size + 1)
    for e in range(len(ends), 0, -1):
        starts, pieces = ends[e - 1]
        backward[starts] = np.logaddexp(backward[starts], backward[e] + p)
        np.add.at(total, pieces, times * np.exp(forward[starts] + p + backward[e] - forward[-1]))
    return total


def long_score(vocabulary: Vocabulary, word: str, log_probability: np.ndarray) -> np.ndarray:
    """``log_scores`` of one word of any length, in logarithms."""
    ends = vocabulary.lattice(word)
    forward = np.zeros((len(ends) + 1, log_probability.shape[1]))
    for e, (starts, pieces) in enumerate(ends, 1):
        forward[e] = np.logaddexp.reduce(forward[starts] + log_probability[pieces], axis=0)
    return forward[-1]


def by_length(found, block: int = 20_000) -> Iterator[list[str]]:
    """Words in blocks of one length."""
    groups: dict[int, list[str]] = {}
    for w in found:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for i in range(0, len(group), block):
            yield group[i : i + block]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_path: str) -> Vocabulary:
    if model_path not in _VOCABULARIES:
        _VOCABULARIES[model_path] = Vocabulary(model_path)
    return _VOCABULARIES[model_path]


def piece_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``piece`` and ``units`` (expected count in units of 1/65536) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                ids = np.flatnonzero(held[lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(held[lang][ids])], ["lang", "piece", "units"])
            held.clear()

        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words(text.as_py()))
            for lang, seen in counts.items():
                total = held.setdefault(lang, np.zeros(v.size + 1, np.int64))
                for w in [w for w in seen if len(w) > MAX_LETTERS]:
                    total += np.rint(long_counts(v, w, seen.pop(w)) * UNIT).astype(np.int64)
                for block in by_length(seen):
                    times = np.array([seen[w] for w in block], np.float64)
                    total += np.rint(expected_counts(v, block, times) * UNIT).astype(np.int64)
                if len(held) > MAX_LANGUAGES:
                    yield from flush()
        yield from flush()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    parts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, piece int, units long")
    return parts.groupBy("lang", "piece").agg(F.sum("units").alias("units"))


def train(docs: DataFrame, model_path: str, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.1) -> list[dict]:
    """Languages, their shares and piece probabilities, from all rows with a language.

    A model has a number for each piece of the vocabulary and each of its languages, which are at most
    MAX_LANGUAGES: more languages are several models, in the order of their names.
    """
    shares = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()  # a row a language
    counts = piece_counts(docs, model_path, text_col=text_col, lang_col=lang_col)
    if len(shares) > MAX_LANGUAGES:
        counts = written(counts, "pieces")
    whole = max(1, sum(r["count"] for r in shares))
    return [_model(shares[i : i + MAX_LANGUAGES], whole, counts, vocabulary(model_path).size, smoothing) for i in range(0, max(1, len(shares)), MAX_LANGUAGES)]


def _model(shares: list, whole: int, found: DataFrame, size: int, smoothing: float) -> dict:
    langs = [r["lang"] for r in shares]
    counts = np.full((size + 1, len(langs)), smoothing)
    if langs:
        place = {lang: i for i, lang in enumerate(langs)}
        found = found.where(F.col("lang").isin(langs)).toArrow()
        at = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
        counts[found["piece"].to_numpy(), at] += found["units"].to_numpy() / UNIT
    probability = np.maximum(counts / counts.sum(axis=0, keepdims=True), 1e-9)
    prior = np.log(np.array([r["count"] for r in shares], np.float64) / whole)
    return {"langs": langs, "probability": probability, "prior": prior}


class Scorer:
    """Scores texts; keeps the scores of words seen, up to a number."""

    def __init__(self, model: dict, model_path: str, table_bytes: int = 64 << 20) -> None:
        self.model, self.vocabulary = model, vocabulary(model_path)
        self.most = min(300_000, table_bytes // (8 * max(1, len(model["langs"]))))
        self.seen: dict[str, int] = {}
        self.table = np.zeros((self.most, len(model["langs"])))
        self.log_probability = np.log(model["probability"])

    def _learn(self, fresh: list[str]) -> None:
        if len(self.seen) + len(fresh) > self.most:
            self.seen.clear()
        for block in by_length(fresh):
            at = len(self.seen)
            self.seen.update(zip(block, range(at, at + len(block)), strict=True))
            self.table[at : at + len(block)] = log_scores(self.vocabulary, block, self.model["probability"])

    def predict(self, texts: list[str | None], slice_words: int = 100_000) -> list[tuple[str | None, float, float]]:
        """The best language, its log probability, and the sum of all languages' shares of that, for each text."""
        if not self.model["langs"]:
            return [(None, 0.0, 0.0)] * len(texts)
        totals = np.tile(self.model["prior"], (len(texts), 1))
        has = np.zeros(len(texts), bool)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def settle() -> None:
            fresh = list(dict.fromkeys(w for w in held if w not in self.seen))
            if len(self.seen) + len(fresh) > self.most:
                self.seen.clear()
                fresh = list(dict.fromkeys(held))
            self._learn(fresh)
            at, found = 0, self.table[[self.seen[w] for w in held]]
            for n, count in owners:
                totals[n] += found[at : at + count].sum(axis=0)
                at += count
            held.clear()
            owners.clear()

        for n, text in enumerate(texts):
            own = words(text)
            has[n] = bool(own)
            if own and len(max(own, key=len)) > MAX_LETTERS:
                for w in own:
                    if len(w) > MAX_LETTERS:
                        totals[n] += long_score(self.vocabulary, w, self.log_probability)
                own = [w for w in own if len(w) <= MAX_LETTERS]
            for i in range(0, len(own), slice_words):
                part = own[i : i + slice_words]
                held.extend(part)
                owners.append((n, len(part)))
                if len(held) >= slice_words:
                    settle()
        if held:
            settle()
        best = totals.argmax(axis=1)
        top = totals[np.arange(len(texts)), best]
        sums = np.exp(totals - top[:, None]).sum(axis=1)
        return [(self.model["langs"][b], float(t), float(s)) if h else (None, 0.0, 0.0) for b, t, s, h in zip(best, top, sums, has, strict=True)]


def predictor(docs: DataFrame, model: dict, model_path: str):
    """A function of a text column giving ``struct<lang:string,top:double,sum:double>`` (see ``Scorer.predict``)."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, top double, sum double")
    def predict(text: pd.Series) -> pd.DataFrame:
        scorer = held(name, lambda: Scorer(shared.value, model_path))
        return pd.DataFrame(scorer.predict(text.tolist()), columns=["lang", "top", "sum"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, training: DataFrame, model_path: str, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` (string) and ``lang_score`` (double).

    The model is learned from all rows of ``training`` that have a language; only texts are
    used to predict.  ``lang_pred`` is a learned language, of equal scores the first by name,
    or ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    The score is the language's share of the text's probability over all languages, weighed by
    their shares of the training rows.  Very long texts are scored whole, repeated rows alike;
    empty tables are no error; columns of these two names are replaced.
    """
    models = train(training, model_path, text_col=text_col, lang_col=lang_col)
    columns = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    own = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text"))
    for n, model in enumerate(models):
        if n:  # one model at a time in a worker
            own = written(own, "languages")
        now = own.select("*", predictor(docs, model, model_path)("text").alias("now"))
        own = now.select("row", "text", (_better(F.col("found"), F.col("now")) if n else F.col("now")).alias("found"))
    share = F.when(F.col("found.lang").isNotNull(), 1.0 / F.col("found.sum")).otherwise(0.0)
    return own.select(*[F.col("row").getField(c).alias(c) for c in columns], F.coalesce("found.lang", F.lit(UNKNOWN)).alias("lang_pred"), share.alias("lang_score"))


def _better(a, b):
    """The better of two models' languages (the first of equals), with the sum of both models' shares of it."""
    turn = b["top"] > a["top"]
    top, rest = F.when(turn, b["top"]).otherwise(a["top"]), F.when(turn, a["top"]).otherwise(b["top"])
    sums = F.when(turn, b["sum"] + a["sum"] * F.exp(rest - top)).otherwise(a["sum"] + b["sum"] * F.exp(rest - top))
    return F.when(a["lang"].isNull(), b).when(b["lang"].isNull(), a).otherwise(F.struct(F.when(turn, b["lang"]).otherwise(a["lang"]).alias("lang"), top.alias("top"), sums.alias("sum")))
