"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of statistics, transformed towards symmetry (logarithms of
sizes, square roots of shares). Per class a mean and a covariance, shrunk towards the
pooled covariance and then towards a multiple of the identity, are fitted; a score is
the logistic of the difference of log densities, computed from Mahalanobis distances
with Cholesky factors that are made once and kept in the model.

The fit uses sums and sums of products over labelled rows, added up in Spark, so neither
rows nor features meet on the driver. At most about `FIT_IDS` labelled ids, by a hash, are
fitted on: their table is small enough to be sent to every task, so only the texts that the
fit needs are read in Python before the scores, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import workers
from marlstone.llm.shingles import as_bytes, mix64, slices, words
from marlstone.plans.materialize import materialize

THRESHOLD = 0.7
#: Labelled ids that the fit looks at; beyond it, the share of ids (by hash) that gives about as many.
FIT_IDS = 50_000
POOLING, RIDGE = 0.5, 0.02
#: The posterior odds count this much evidence for each nat of density difference.
TEMPER = 0.5

_KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)) + bytes(range(192, 256)), "digit": b"0123456789",
    "pipe": b"|", "loud": b"!?", "stop": b".,;:", "symbol": b"#$%&*@^~+=<>{}[]\\/_",
}
_TABLES = {}
for _name, _members in _KINDS.items():
    _TABLES[_name] = np.zeros(256, np.uint8)
    _TABLES[_name][list(_members)] = 1
_LEAD = np.ones(256, np.uint8)
_LEAD[128:192] = 0

FEATURES = ("words", "lines", "word_length", "word_spread", "longest", "upper", "digit", "symbol", "pipe", "loud", "stop",
            "variety", "line_words", "repeated_pairs", "single", "capital_words")


def _sums(values: np.ndarray, offsets: np.ndarray, how=np.add, dtype=np.int64) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = how.reduceat(values, offsets[some], dtype=dtype)
    return out


def _distinct(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    mixed = np.unique((mix64(values ^ mix64(doc + np.uint64(1))) & ~np.uint64(0xFFFFFF)) | (doc & np.uint64(0xFFFFFF)))
    return np.bincount((mixed & np.uint64(0xFFFFFF)).astype(np.int64), minlength=len(offsets) - 1)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, len(FEATURES)) transformed statistics of whole texts."""
    count = {k: _sums(t[raw], offsets) for k, t in _TABLES.items()}
    chars = np.maximum(_sums(_LEAD[raw], offsets), 1)
    lines = _sums((raw == 10).view(np.uint8), offsets) + 1
    hashes, starts, bounds = words(raw, offsets)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    inside = np.concatenate((np.cumsum(_LEAD[raw], dtype=np.int64), [0]))
    space = np.flatnonzero(np.isin(raw, np.array([9, 10, 11, 12, 13, 32], np.uint8)))
    close = np.searchsorted(space, starts)
    end = np.minimum(np.append(space, len(raw))[close], offsets[np.searchsorted(offsets, starts, "right")]) if len(starts) else starts
    length = (inside[end - 1] - inside[starts] + 1) if len(starts) else starts
    mean = _sums(length, bounds) / some
    spread = np.sqrt(np.maximum(_sums(length * length, bounds) / some - mean**2, 0))
    pair = np.zeros(len(hashes), np.uint64)
    pair[1:] = hashes[1:] * np.uint64(3) + hashes[:-1]
    pairs = np.maximum(n - 1, 1)
    # the first word of a text starts no pair of its own; it counts as one more distinct value
    repeated = np.clip((pairs - (_distinct(pair, bounds) - 1)) / pairs, 0, 1) * (n > 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    first = _TABLES["upper"][raw[starts]] if len(starts) else np.zeros(0, np.uint8)
    share = lambda a, b: np.sqrt(a / b)
    out = np.column_stack([
        np.log1p(n), np.log1p(lines), np.log1p(mean), np.log1p(spread), np.log1p(_sums(length, bounds, np.maximum)),
        share(count["upper"], letters), share(count["digit"], chars), share(count["symbol"], chars), share(count["pipe"], chars),
        share(count["loud"], chars), share(count["stop"], chars), np.log1p(_distinct(hashes, bounds)) / np.log1p(some),
        np.log1p(n / lines), np.sqrt(repeated), share(_sums((length == 1).view(np.uint8), bounds), some),
        share(_sums(first, bounds), some)])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    raw, offsets = as_bytes(column)
    return np.concatenate([statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 19)]
                          or [np.zeros((0, len(FEATURES)))])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("quality", batches):
            x = _matrix(batch.column(1))
            offsets = np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether the rows of this id are kept from the fit: crc32 of the id as text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, their log determinants
    and the log odds of the priors; `score` needs nothing else."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    log_odds: float

    @staticmethod
    def fit(n: np.ndarray, total: np.ndarray, product: np.ndarray, pooling: float = POOLING, ridge: float = RIDGE) -> Discriminant:
        """From counts (2), sums (2, d) and sums of products (2, d, d) of the classes.

        A class counts as n / (n + 2 * pooling * d) of its own covariance and leans on the
        pooled one for the rest, so a class of few rows moves to it without a step. A class
        without rows borrows the other's moments, so its scores say the prior.
        """
        d = total.shape[1]
        m = np.maximum(n, 1)
        means = np.where(n[:, None] > 0, total / m[:, None], total.sum(0) / max(n.sum(), 1))
        scatter = product - m[:, None, None] * means[:, :, None] * means[:, None, :]
        scatter = np.where(n[:, None, None] > 0, scatter, 0)
        pooled = scatter.sum(0) / max(n.sum(), 1)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        factors, logdets = [], []
        for c in range(2):
            weight = (1 - pooling) * n[c] / max(n[c] + 2 * pooling * d, 1)
            cov = (weight * scatter[c] / m[c] + (1 - weight) * pooled) / np.outer(scale, scale)
            cov = (1 - ridge) * cov + ridge * np.eye(d) * max(np.trace(cov) / d, 1e-3)
            factor = np.linalg.cholesky(cov * np.outer(scale, scale))
            factors.append(np.linalg.inv(factor))
            logdets.append(2 * np.log(np.diag(factor)).sum())
        odds = np.log((n[1] + 1) / (n[0] + 1))
        return Discriminant(means, np.array(factors), np.array(logdets), float(odds))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log = [-0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) - 0.5 * self.logdets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(TEMPER * (log[1] - log[0]) + self.log_odds, -60, 60)))


def fit_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_ids: int = FIT_IDS) -> DataFrame:
    """(doc_id, n0, n1): how often each id to fit on has label 0 and 1; other labels, null
    ids and held out ids are skipped. About `fit_ids` rows at most."""
    y = F.col(label_col).cast("int")
    counted = (labels.select(F.col(id_col).cast("long").alias("doc_id"), y.alias("y")).filter("y in (0, 1) and doc_id is not null")
               .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")))
    counted = materialize(counted, "labels")
    share, whole = fit_ids / max(counted.count(), 1), 1 << 30
    return counted if share >= 1 else counted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < int(share * whole))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                fit_ids: int = FIT_IDS) -> Discriminant:
    """Fit on the texts of labelled ids that are not held out."""
    d = len(FEATURES)
    chosen = fit_labels(labels, id_col, label_col, fit_ids)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # both broadcasts hold about fit_ids rows of three numbers at most
    rows = document_statistics(named.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")

    # sums of products of (1, statistics), in the JVM, as a second Python stage would double the workers
    cell = lambda i: F.lit(1.0) if i == 0 else F.col("stats")[i - 1]
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    held = np.zeros((2, d + 1, d + 1))
    weighed = rows.select("stats", F.inline(F.array(*[F.struct(F.lit(c).alias("y"), F.col(f"n{c}").alias("w")) for c in (0, 1)]))).filter("w > 0")
    for row in weighed.groupBy("y").agg(*[F.sum(cell(i) * cell(j) * F.col("w")).alias(f"s{i}_{j}") for i, j in upper]).collect():
        for (i, j), value in zip(upper, row[1:], strict=True):
            held[row["y"], i, j] = held[row["y"], j, i] = value
    return Discriminant.fit(held[:, 0, 0], held[:, 0, 1:], held[:, 1:, 1:])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text is scored as an empty one. A null doc_id is never held out and never
    labelled. Without any labels every score is 0.5 and nothing is predicted 1. Repeated
    rows get equal scores; repeated labels count each time. Other columns are not used.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("quality", batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents, all columns, that the classifier predicts as 1. Texts are scored
    where they are read, so no text is shuffled. Null and empty texts, repeated rows, null
    ids and missing labels are judged as in `quality_scores`; empty input stays empty."""
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("quality", batches):
            for a in range(0, batch.num_rows, 512):  # small pieces, as whole rows are copied here
                part = batch.slice(a, 512)
                yield part.filter(pa.array(model.score(_matrix(part.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
