"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the documents' transformed statistics.  The
covariance is shrunk towards the pooled one and that towards its mean variance, so that it has
a Cholesky factor at every size; a document's score is the logistic of the difference of the
two classes' log-densities (Mahalanobis distance and log-determinant from the factors, made
once) and log-shares.

Statistics are counted on the texts' bytes.  Class sums and products are gathered over all
labelled rows: one short row per class and task reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotally.llm.bytewords import slices
from geotally.llm.common import cut

#: The statistics, in order.
STATISTICS = (
    "log_words", "log_chars_per_word", "upper", "digit", "mark", "other_ascii", "high",
    "line_ends", "words_with_mark", "words_all_upper", "distinct_words", "repeated_next",
    "distinct_fourgrams", "mark_runs",
)

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_HIGH = np.arange(256) >= 0x80
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:'\"-()?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _COMMON | _SPACE)


def _logit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of a share x / n."""
    return np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of every text, one row each (null and empty texts: all counts 0)."""
    out = np.zeros((len(column), len(STATISTICS)))
    for w in slices(column):
        n = len(w.bounds) - 1
        data, owners = w.data, w.owners()
        n_words = np.diff(w.bounds).astype(float)
        n_bytes = np.diff(w.offsets).astype(float)

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (total[w.offsets[1:]] - total[w.offsets[:-1]]).astype(float)

        def per_word(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[w.ends] - total[w.starts]

        of_texts = lambda flags: np.bincount(owners, flags, n)[:n]
        upper, mark = _UPPER[data], _MARK[data]
        hashes = w.hashes()
        size = w.ends - w.starts
        same_next = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
        grams = np.zeros(0, np.uint64)
        gram_owner = np.zeros(0, np.int64)
        if len(hashes) >= 4:
            step = np.uint64(0x9E3779B97F4A7C15)
            grams = ((hashes[:-3] * step + hashes[1:-2]) * step + hashes[2:-1]) * step + hashes[3:]
            inside = owners[:-3] == owners[3:]
            grams, gram_owner = grams[inside], owners[:-3][inside]
        n_grams = np.bincount(gram_owner, minlength=n)[:n].astype(float)
        runs = np.concatenate([[False], mark[1:] & mark[:-1], [False]])
        runs[w.offsets] = False  # a run doesn't go on from one text to the next
        runs = runs[: len(mark)]
        columns = (
            np.log1p(n_words),
            np.log1p(n_bytes / np.maximum(n_words, 1)),
            _logit(per_text(upper), n_bytes),
            _logit(per_text(_DIGIT[data]), n_bytes),
            _logit(per_text(mark), n_bytes),
            _logit(per_text(_COMMON[data]), n_bytes),
            _logit(per_text(_HIGH[data]), n_bytes),
            _logit(per_text(_LINE[data]), n_bytes),
            _logit(of_texts(per_word(mark) > 0), n_words),
            _logit(of_texts((per_word(upper) >= 2) & (per_word(_LOWER[data]) == 0) & (size > 1)), n_words),
            _logit(_distinct(hashes, owners, n), n_words),
            _logit(of_texts(np.concatenate([same_next, [False]])) if len(hashes) else np.zeros(n), n_words),
            _logit(_distinct(grams, gram_owner, n), n_grams),
            _logit(per_text(runs), n_bytes),
        )
        out[w.first : w.first + n] = np.stack(columns, axis=1)
    return out


def _distinct(hashes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    if not len(hashes):
        return np.zeros(n)
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return np.bincount(o[new], minlength=n)[:n].astype(float)


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (array of double), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array(x.ravel())
            starts = pa.array(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, flat)], ["doc_id", "x"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, x array<double>")


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class of ``label``: count, sum and sum of products of ``x``."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [0.0, np.zeros(d), np.zeros((d, d))] for c in (0, 1)}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c, sums in held.items():
                own = x[labels == c]
                sums[0] += len(own)
                sums[1] += own.sum(axis=0)
                sums[2] += own.T @ own
        rows = [(c, np.concatenate([[s[0]], s[1], s[2].ravel()])) for c, s in held.items() if s[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.int32()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], ["label", "sums"]
        )

    parts = labelled.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(run, "label int, sums array<double>")
    # Sums of each number, in fixed point, so that they don't depend on the order of tasks.
    summed = (
        parts.select("label", F.posexplode("sums").alias("at", "value"))
        .groupBy("label", "at").agg(F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("value"))
        .collect()
    )
    found = {}
    for c in {r["label"] for r in summed}:
        values = np.zeros(1 + d + d * d)
        for r in summed:
            if r["label"] == c:
                values[r["at"]] = r["value"]
        found[c] = (values[0], values[1 : 1 + d], values[1 + d :].reshape(d, d))
    return found


def fit(labelled: DataFrame, *, to_pooled: float = 0.2, to_round: float = 0.02) -> dict:
    """Model of a table with ``label`` (0 or 1; other rows don't count) and ``x``.

    ``to_pooled`` is the share of the pooled covariance in each class's, ``to_round`` that of
    the mean variance's multiple of the identity.
    """
    d = len(STATISTICS)
    moments = _moments(labelled.where("label IN (0, 1) AND x IS NOT NULL"))
    covariances = {c: (p / n - np.outer(s / n, s / n), n) for c, (n, s, p) in moments.items()}
    total = sum(n for _, n in covariances.values())
    pooled = sum((v * n for v, n in covariances.values()), np.zeros((d, d))) / max(total, 1)
    model = {}
    for c, (v, n) in covariances.items():
        v = (1 - to_pooled) * v + to_pooled * pooled
        v = (1 - to_round) * v + (to_round * max(np.trace(v) / d, 1e-6)) * np.eye(d)
        factor = np.linalg.cholesky(v)
        model[c] = {"mean": moments[c][1] / n, "factor": factor, "inverse": np.linalg.inv(factor), "log_det": 2 * np.log(np.diag(factor)).sum(), "log_share": np.log(n / total)}
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-density and log-share of class 1 less those of class 0."""
    if set(model) != {0, 1}:  # one class or none was seen: its share decides
        return np.full(len(x), {(0,): -20.0, (1,): 20.0}.get(tuple(model), 0.0))
    part = {}
    for c, m in model.items():
        z = (x - m["mean"]) @ m["inverse"].T
        part[c] = m["log_share"] - 0.5 * (m["log_det"] + (z * z).sum(axis=1))
    return part[1] - part[0]


def classify(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labels_id_col: str = "doc_id", learn_from=None
) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), a row per input row.

    Learns from the rows of ``labels`` that are 0 or 1 and whose id is in ``docs`` (with
    ``learn_from``, a condition on ``doc_id``, only from those where it holds).  Null and empty
    texts have a score like any other, from statistics of no words.  Rows with a null id are
    scored, not learned from; an id that is repeated in ``labels`` or ``docs`` counts once a
    pair.  Without labels of both classes every score is the one class's (or one half).
    """
    stats = cut(with_statistics(docs, id_col=id_col, text_col=text_col))
    known = labels.select(F.col(labels_id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    if learn_from is not None:
        known = known.where(learn_from)
    model = stats.sparkSession.sparkContext.broadcast(fit(stats.join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = log_odds(model.value, batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS)))
            score = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")
