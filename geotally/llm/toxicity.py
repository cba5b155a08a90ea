"""Toxicity by a fuzzy lexicon: Levenshtein automata intersected with a trie, in context.

The lexicon (words and stems) is learned from labelled documents and held in a trie.  The
Levenshtein automaton of a word is a set of bits for each number of errors: bit j is set where
the first j letters can stand at a node of the trie.  A walk through the trie moves the
automata of many words at once and leaves those behind that can't reach a term any more.  A
misspelling may be at any letter, the first one too.  Each hit is seen in a window of words
around it, whose quotation marks and reporting words speak for a quotation and whose forms of
address speak for abuse; a logistic model weighs hits, quoted hits and context.

Only learning is bounded: it takes at most ``LEARN_ROWS`` labelled rows of each class (those
with the smallest hash of their id).  All texts are scored whole.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.common import cut, held

#: Bound of the sample that is learned from, for each class.
LEARN_ROWS = 10_000
#: Longest words whose automata fit the bits of an array's numbers; longer ones go one by one.
ARRAY_LETTERS = 62
#: Words go through the trie in groups of such lengths, each with the terms that it can be near.
LENGTHS = (4, 6, 8, 10, 12, 15, 30, ARRAY_LETTERS)
STEM_LETTERS = (4, 5, 6)
#: Words on each side of a hit that are its context.
WINDOW = 8

# Characters that stand for letters, and words of quotation and of address.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}
REPORTING = frozenset("said says wrote writes quoted quote called calls according reported term word insult dit écrit selon mot sagte schrieb zitiert laut wort dijo escribió según palabra".split())
ADDRESS = frozenset("you your yourself tu toi te vous du dich dir ihr eres usted tú ti".split())
QUOTES = "\"'“”„«»‘’"

_WORD = re.compile(r"[^\W\d_]+")
_LOOKALIKE = re.compile(r"[01345@$](?<![\d_].)(?=[^\W\d_])")

# What the weights shrink to where labels say little.
PRIOR = np.array([-2.0, 1.5, 1.0, -0.5, 1.0, 0.5, 0.5])


def clean(text: str | None) -> str:
    """Lower case, look-alike characters before a letter as letters (not after a digit)."""
    return _LOOKALIKE.sub(lambda m: LOOKALIKES[m[0]], text.lower()) if text else ""


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms in a trie, and the search of all words near one of them.

    ``terms``: word -> weight; ``stems``: beginnings -> weight, which accept any ending;
    ``clean_words``: words that are no misspellings.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean_words: frozenset[str] = frozenset()) -> None:
        self.clean_words = clean_words
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, int] | None] = [None]  # weight, errors allowed
        self.stem_ends: list[tuple[float, int] | None] = [None]
        for table, ends in ((terms, "ends"), (stems, "stem_ends")):
            for term, weight in table.items():
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(None)
                        self.stem_ends.append(None)
                    node = self.children[node][c]
                getattr(self, ends)[node] = (weight, errors_allowed(term))
        self.depth = [0] * len(self.children)
        for node, children in enumerate(self.children):
            for x in children.values():
                self.depth[x] = self.depth[node] + 1
        self._within: dict[tuple[int, int], list[int]] = {}
        self.allowed = self.errors_within(0, 1 << 62)

    def errors_within(self, least: int, most: int) -> list[int]:
        """For each node, the most errors that a term at or below it allows, of the terms that words of
        ``least`` to ``most`` letters can be near (and all stems); -1 where there is none."""
        if (least, most) not in self._within:
            out = [-1] * len(self.children)
            for node in range(len(out) - 1, -1, -1):  # children come after their parents
                own = [out[x] for x in self.children[node].values()]
                if (end := self.ends[node]) and least - end[1] <= self.depth[node] <= most + end[1]:
                    own.append(end[1])
                if self.stem_ends[node]:
                    own.append(self.stem_ends[node][1])
                out[node] = max(own, default=-1)
            self._within[least, most] = out
        return self._within[least, most]

    @staticmethod
    def _step(before: list, letters, full, most: int) -> list:
        """The automata after one more letter of the trie: for each number of errors up to
        ``most``, the numbers of letters of the word that may be used up.

        ``letters`` has a bit where the word has that letter, ``full`` the bits of its length.
        """
        after: list = []
        for e in range(most + 1):
            bits = (before[e] & letters) << 1
            if e:  # the trie's letter left out or another in its place; then a letter more in the word
                bits = bits | before[e - 1] | (before[e - 1] << 1) | (after[e - 1] << 1)
            after.append(bits & full)
        return after

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and errors of the nearest term, or of a stem that the word begins with."""
        places: dict[str, int] = {}
        for j, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << j
        full, last = (2 << len(word)) - 1, 1 << len(word)
        best: tuple[int, float] | None = None  # errors, minus the weight
        stack = [(0, [((2 << e) - 1) & full for e in range(self.allowed[0] + 1)])]
        while stack:
            node, bits = stack.pop()
            for c, child in self.children[node].items():
                now = self._step(bits, places.get(c, 0), full, self.allowed[child])
                if not now[-1]:
                    continue
                for end, reached in ((self.ends[child], last), (self.stem_ends[child], full)):
                    errors = next((e for e in range(end[1] + 1) if now[e] & reached), None) if end else None
                    if errors is not None and (best is None or (errors, -end[0]) < best):
                        best = errors, -end[0]
                stack.append((child, now))
        return None if best is None or (best[0] and word in self.clean_words) else (-best[1], best[0])

    def match_all(self, words: list[str]) -> dict[str, tuple[float, int]]:
        """``match`` of many words, those only that have a hit."""
        found = {w: hit for w in words if len(w) > ARRAY_LETTERS and (hit := self.match(w))}
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(bisect_left(LENGTHS, len(w)), []).append(w)
        groups.pop(len(LENGTHS), None)
        for g, own in groups.items():
            found.update(self._match_array(own, np.uint32 if LENGTHS[g] < 31 else np.uint64))
        return {w: hit for w, hit in found.items() if not hit[1] or w not in self.clean_words}

    def _match_array(self, words: list[str], kind) -> dict[str, tuple[float, int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        allowed = self.errors_within(int(sizes.min()), width)
        if allowed[0] < 0:
            return {}
        codes = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        known = np.array(sorted({ord(c) for x in self.children for c in x}), np.uint32)
        number = np.searchsorted(known, codes)
        number[known[np.minimum(number, len(known) - 1)] != codes] = len(known)  # letters that no term has
        has, every = np.zeros((len(known) + 1, len(words)), kind), np.arange(len(words))
        for j in range(width):
            has[number[:, j], every] |= kind(1) << kind(j)
        letters = {chr(c): has[i] for i, c in enumerate(known)}
        last = kind(1) << sizes.astype(kind)
        full = (last - kind(1)) | last
        best_errors = np.full(len(words), 99, np.int8)
        best_weight = np.zeros(len(words))
        one = kind(1)

        def note(at: np.ndarray, errors: int, weight: float) -> None:
            better = (errors < best_errors[at]) | ((errors == best_errors[at]) & (weight > best_weight[at]))
            best_errors[at[better]], best_weight[at[better]] = errors, weight

        stack = [(0, np.arange(len(words)), [np.full(len(words), (2 << e) - 1, kind) & full for e in range(allowed[0] + 1)], full)]
        while stack:
            node, at, bits, own_full = stack.pop()
            for c, child in self.children[node].items():
                if allowed[child] < 0:
                    continue
                # Only automata that are not empty move on; letters that they lack cost an error.
                own = letters[c][at]
                now = []
                for e in range(allowed[child] + 1):
                    moved = (bits[e] & own) << one
                    if e:
                        moved |= bits[e - 1] | (bits[e - 1] << one) | (now[e - 1] << one)
                    moved &= own_full
                    now.append(moved)
                live = now[-1] != 0
                if not live.any():
                    continue
                to, to_full = at, own_full
                if np.count_nonzero(live) < 0.8 * len(live):
                    to, to_full, now = at[live], own_full[live], [x[live] for x in now]
                end = self.ends[child]
                if end:
                    for e in range(min(end[1], allowed[child]) + 1):
                        note(to[(now[e] & last[to]) != 0], e, end[0])
                end = self.stem_ends[child]
                if end:
                    for e in range(end[1] + 1):
                        note(to[now[e] != 0], e, end[0])
                if self.children[child]:
                    stack.append((child, to, now, to_full))
        hits = np.flatnonzero(best_errors < 99)
        return {words[i]: (float(best_weight[i]), int(best_errors[i])) for i in hits}


FEATURES = len(PRIOR)


class Scorer:
    """Features of texts; keeps what it found for the words seen, up to a number."""

    def __init__(self, lexicon: Lexicon, most: int = 400_000) -> None:
        self.lexicon, self.most = lexicon, most
        self.seen: set[str] = set()
        self.bad: dict[str, tuple[float, int]] = {}

    def features_of(self, texts: list[str | None], slice_chars: int = 8_000_000) -> list[np.ndarray]:
        """The features of each text; words are looked up for many texts at once."""
        out, part, size = [], [], 0
        for text in texts:
            low = clean(text)
            part.append((low, _WORD.findall(low)))
            size += len(low)
            if size > slice_chars:
                out += self._features(part)
                part, size = [], 0
        return out + self._features(part)

    def features(self, text: str | None) -> np.ndarray:
        return self.features_of([text])[0]

    def _features(self, part: list[tuple[str, list[str]]]) -> list[np.ndarray]:
        own = set().union(*(found for _, found in part))
        fresh = own - self.seen
        if len(self.seen) + len(fresh) > self.most:
            self.seen.clear()
            self.bad.clear()
            fresh = own
        self.bad.update(self.lexicon.match_all(list(fresh)))
        self.seen |= fresh
        return [self._of(low, found) for low, found in part]

    def _of(self, low: str, found: list[str]) -> np.ndarray:
        x = np.zeros(FEATURES)
        x[0] = 1.0
        if self.bad.keys().isdisjoint(found):
            return x
        exact = fuzzy = quoted = 0
        cues, strongest = 0.0, 0.0
        places = [i for i, w in enumerate(found) if w in self.bad]
        hits = len(places)
        # Without a quotation mark nothing is quoted, and no word's place in the text matters.
        spans = [m.span() for m in _WORD.finditer(low)] if any(q in low for q in QUOTES) else None
        for i in places:
            weight, errors = self.bad[found[i]]
            a, b = max(0, i - WINDOW), min(len(found), i + WINDOW + 1)
            around = set(found[a:i] + found[i + 1 : b])
            reports = sum(c in REPORTING for c in found[a:i] + found[i + 1 : b]) if not REPORTING.isdisjoint(around) else 0
            marks = is_quoted = False
            if spans:
                left, right = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
                marks = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                is_quoted = marks and (reports > 0 or left.rstrip()[-1:] in QUOTES)
            quoted += is_quoted
            exact += not is_quoted and not errors
            fuzzy += not is_quoted and errors > 0
            address = sum(c in ADDRESS for c in found[a:i] + found[i + 1 : b]) if not ADDRESS.isdisjoint(around) else 0
            cues += address - reports - marks
            strongest = max(strongest, weight / (1 + errors))
        x[1:] = np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), min(strongest, 8.0) / 8.0, np.log1p(1000.0 * hits / len(found)) / 5.0, np.tanh(cues / hits)
        return x


def sample(labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """``doc_id`` and ``label`` of at most ``rows`` rows of each class, by the hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def word_counts(rows: DataFrame) -> DataFrame:
    """``key``, ``toxic`` and ``other``: in how many texts of either label a word ("w:...") or a
    beginning of words ("p:...") is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([held[c][k] for k in keys], pa.int64()) for c in (1, 0))], ["key", "toxic", "other"]
            )
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = set(_WORD.findall(clean(text.as_py())))
                held[label].update("w:" + w for w in own)
                held[label].update({"p:" + w[:n] for w in own for n in STEM_LETTERS if len(w) > n})
                if len(held[0]) + len(held[1]) > 500_000:
                    yield flush()
        yield flush()

    parts = rows.select("text", "label").mapInArrow(run, "key string, toxic long, other long")
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _log_odds(toxic, other, n_toxic: int, n_other: int):
    return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((other + 0.5) / (n_other + 1.0))


def learn_lexicon(counts: DataFrame, n_toxic: int, n_other: int) -> Lexicon:
    """Terms and stems that toxic texts have far more often, and clean words near them.

    All of them count; the rows that were learned from are their bound.
    """
    share = n_toxic / max(1, n_toxic + n_other)
    # Chance that all texts with the word fall among the toxic ones: share ** toxic.
    enough = max(3, int(np.ceil(np.log(1e-4) / np.log(min(max(share, 1e-6), 0.9)))))
    strong = (
        counts.where(F.col("toxic") >= 2).withColumn("weight", _log_odds(F.col("toxic"), F.col("other"), n_toxic, n_other))
        .where("weight > 3").collect()
    )
    words = {r["key"][2:]: (r["weight"], r["toxic"]) for r in strong if r["key"][0] == "w"}
    begins = Counter(w[:n] for w in words for n in STEM_LETTERS)
    stems: dict[str, float] = {}
    for r in sorted((r for r in strong if r["key"][0] == "p"), key=lambda r: (len(r["key"]), r["key"])):
        stem = r["key"][2:]
        if r["toxic"] >= enough and begins[stem] >= 4 and r["other"] <= r["toxic"] / 50 and not any(stem[:n] in stems for n in STEM_LETTERS):
            stems[stem] = r["weight"]
    terms = {w: weight for w, (weight, n) in words.items() if n >= enough and not any(w[:k] in stems for k in STEM_LETTERS)}
    near = Lexicon(terms, stems)

    @F.pandas_udf("boolean")
    def misspelt(key: pd.Series) -> pd.Series:
        found = near.match_all([k[2:] for k in key])
        return pd.Series([bool((hit := found.get(k[2:])) and hit[1]) for k in key])

    innocent = (
        counts.where("other >= 1 AND key LIKE 'w:%'").where(_log_odds(F.col("toxic"), F.col("other"), n_toxic, n_other) < 1)
        .where(misspelt("key")).collect()
    )
    return Lexicon(terms, stems, frozenset(r["key"][2:] for r in innocent))


def fit_weights(x: np.ndarray, y: np.ndarray, case_weight: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic weights by Newton steps, shrunk to ``PRIOR``."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (case_weight * (y - p)) - strength * (w - PRIOR)
        curve = (x * (case_weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(FEATURES)
        step = np.linalg.solve(curve, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features_udf(shared, name: str):
    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        scorer = held(name, lambda: Scorer(shared.value))
        return pd.Series(scorer.features_of(text.tolist()), dtype=object)

    return features.asNondeterministic()


def classify(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from=None, learn_rows: int = LEARN_ROWS
) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), a row per input row.

    Learns from at most ``learn_rows`` rows of each class of ``labels`` (``doc_id`` and
    ``label_col``; with ``learn_from``, a condition on ``doc_id``, of those where it holds)
    whose texts are in ``docs``.  A null or empty text and one without hits have the score of
    no hits.  Very long texts are scored whole.  Rows with a null id are scored and not learned
    from; labels other than 0 and 1 say nothing; without labels the lexicon is empty; an empty
    table gives an empty table.  Repeated rows are scored alike; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(learn_from) if learn_from is not None else labels
    totals = {r["label"]: r["count"] for r in known.select(F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").groupBy("label").count().collect()}
    chosen = F.broadcast(sample(known, label_col, learn_rows))  # at most 2 * learn_rows short rows
    learned = cut(texts.join(chosen, "doc_id").where("text IS NOT NULL"))
    counts = cut(word_counts(learned))
    n = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    lexicon = spark.sparkContext.broadcast(learn_lexicon(counts, n.get(1, 0), n.get(0, 0)))
    name = uuid.uuid4().hex
    features = _features_udf(lexicon, name)
    rows = learned.select("label", features("text").alias("x")).toArrow()
    weights = PRIOR
    if rows.num_rows:
        y = rows["label"].to_numpy().astype(float)
        x = np.array(rows["x"].to_pylist())
        back = {c: totals.get(c, 0) / max(1, n.get(c, 0)) for c in (0, 1)}  # a sampled row stands for so many
        case_weight = np.where(y == 1, back[1], back[0])
        weights = fit_weights(x, y, case_weight / case_weight.mean())
    w = F.array(*[F.lit(float(v)) for v in weights])
    odds = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = texts.select("doc_id", features("text").alias("x")).select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
