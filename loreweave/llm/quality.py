"""Quality classifier by importance resampling over hashed n-grams.

Two bags of hashed words and word pairs are fitted: one on labelled good rows,
one on all rows. The log of their ratio, summed over a text's n-grams, is its
importance weight; adding Gumbel noise and keeping the k largest sums draws k
rows without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import stage
from .toxicity import _parts, sample_labels

BUCKETS = 1 << 15


def _grams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of each pair of neighbours, and its row."""
    h, first, end = tb.words(*tb.columns(arr))
    row = np.repeat(np.arange(len(first)), end - first)
    pair = tb.mix(h[:-1] * tb._K[0] + h[1:] * tb._K[2])[row[:-1] == row[1:]] if len(h) else h
    return (np.concatenate((h, pair)) % tb.U(BUCKETS)).astype(np.int64), np.concatenate((row, row[:-1][row[:-1] == row[1:]])) if len(h) else row


def _counts(texts: DataFrame) -> np.ndarray:
    """n-grams by bucket over all rows: summed in each task, then by bucket; the driver gets BUCKETS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, part in _parts(b.column("text")):
                total += np.bincount(_grams(part)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_weight(docs: DataFrame, labels: DataFrame, sample: int = 20_000, smooth: float = 0.5):
    """The column function of log importance weights, and the labelled sample (text, label) it was fitted on.

    Null and empty texts weigh 0; without labelled good rows every text does.
    Raw counts are of all rows of ``docs``, good ones of at most ``sample``
    labelled rows; repeated rows count as often as they occur.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, "quality", sample)), "doc_id").select("text", "label")
    good, raw = _counts(rows.where("label = 1")), _counts(docs)
    ratio = np.log((good + smooth) / (good.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS)) if good.any() else np.zeros(BUCKETS)

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        parts = []
        for part in tb.slices(texts):
            bucket, row = _grams(part)
            parts.append(np.bincount(row, ratio[bucket], minlength=len(part)))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return weight, rows


def break_even(weights: np.ndarray, label: np.ndarray) -> float:
    """The weight from which on the labelled rows are mostly good: fewest rows on the wrong side."""
    if not len(label) or label.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], label[order]
    wrong = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    at = int(wrong.argmin())
    return -np.inf if at == 0 else np.inf if at == len(w) else (w[at - 1] + w[at]) / 2


def gumbel(seed: int = 7) -> F.Column:
    """Gumbel noise that is a fixed function of the row's id and ``seed``."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, k: int, bins: int = 4096, direct: int = 4096) -> float:
    """The k-th largest ``key`` (finite doubles), by histograms that narrow until few rows are left."""
    lo, hi = scores.agg(F.min("key"), F.max("key")).first()
    if k <= 0:
        return float("inf")
    while True:
        inside = scores.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        hist = {r[0]: r[1:] for r in inside.groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for b in sorted(hist, reverse=True):
            n, low, high = hist[b]
            if n < k:
                k -= n
                continue
            lo, hi = low, high
            break
        else:
            return lo
        if n <= direct:
            return scores.where((F.col("key") >= lo) & (F.col("key") <= hi)).select("key").orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 7, sample: int = 20_000) -> DataFrame:
    """Every column of ``docs`` with ``log_weight``, ``gumbel_key`` and ``selected``; k rows are selected.

    ``keep`` is the share of rows to draw. Where it is None, k is the number of
    rows whose weight is at least the break-even weight of the labelled sample
    (at most ``sample`` rows, by hash of the id). Rows whose keys tie at the
    k-th place are all selected. Null and empty texts have weight 0. Without
    labelled good rows all weights are 0. A null id has no noise. Columns of
    the three names are replaced. An empty table gives an empty table.
    """
    weight, labelled = log_weight(docs, labels, sample)
    scored = docs.withColumn("log_weight", weight(F.col("text"))).withColumn("gumbel_key", F.col("log_weight") + F.coalesce(gumbel(seed), F.lit(0.0)))
    # keys without texts: histograms read them again and again; texts are scored once more at the end, which is cheaper than to write and join them
    keys = stage(scored.select("log_weight", F.col("gumbel_key").alias("key")))
    n = keys.count()
    if keep is None:
        fitted = labelled.select(weight(F.col("text")).alias("w"), "label").toPandas()
        least = break_even(fitted["w"].to_numpy(float), fitted["label"].to_numpy())
        k = n if least == -np.inf else keys.where(F.col("log_weight") >= float(least)).count()
    else:
        k = min(n, round(keep * n))
    bound = kth_largest(keys, k) if n and k < n else float("-inf") if n else 0.0
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(bound))
