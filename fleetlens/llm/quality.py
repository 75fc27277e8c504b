"""Quality by importance resampling.

Two hashed n-gram models, of the target (texts labelled good) and of all raw text, give
each text the log of its importance weight.  Adding Gumbel noise and taking the k largest
sums draws k texts without replacement in proportion to their weights.  The k-th
largest is found by counting in ever finer bins, so nothing is sorted or collected.

The caller names k, as a number or as a share of the rows.  Without either, weights are
taken against the level that best parts good from bad labelled texts: the log ratio a word
that is as likely good as bad comes off each word, so that a text's weight says on which
side it lies, whatever its length, and k is the number of texts with a weight above 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, first_by_hash, kind, pieces, saved, small_batches


@dataclass(frozen=True)
class Settings:
    """``buckets`` of hashed words and word pairs; at most ``rows`` labelled rows a class are read, first by hash, and one in ``folds`` sets the level; ``smoothing`` is added to each bucket's count.  ``keep`` rows (a number from 1 on) or this share of them (below 1) are drawn by plain likelihood ratios; without, those that the level favours."""

    keep: float | None = None
    buckets: int = 1 << 17
    rows: int = 8000
    folds: int = 4
    smoothing: float = 0.5
    seed: int = 11
    bins: int = 512


def grams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, text after text, and each text's number of them."""
    each = [list(map(xxhash.xxh64_intdigest, t.split())) for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    h = np.array([x for e in each for x in e], np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0xD1B54A32D192ED03))
    out = np.zeros(2 * len(h), np.int64)
    out[::2] = h % np.uint64(buckets)
    out[1:-1:2] = (pairs ^ (pairs >> np.uint64(32))) % np.uint64(buckets)
    whole = np.ones(2 * len(h), bool)
    ends = np.cumsum(sizes)
    whole[2 * ends[sizes > 0] - 1] = False  # no pair reaches into the next text
    return out[whole], np.maximum(0, 2 * sizes - 1)


def _counts(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches):
            total += np.bincount(grams(as_bytes(b.column(0)), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 65536].astype(np.int32)), pa.array(total[used[i : i + 65536]])], ["bucket", "n"])

    return run


def model(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Log probabilities of the buckets over all of ``texts`` (one column)."""
    found = texts.mapInArrow(_counts(settings.buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = np.full(settings.buckets, settings.smoothing)
    counts[found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(float)
    return np.log(counts / counts.sum())


@dataclass
class Importance:
    """Log ratio of the two models by bucket, and the level of a word or pair that parts good from bad."""

    ratio: np.ndarray
    level: float

    def weigh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of each text, and how many words and pairs it has."""
        at, sizes = grams(texts, len(self.ratio))
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes] - self.level * sizes, sizes


def best_level(mean: np.ndarray, good: np.ndarray) -> float:
    """The level with the fewest mistakes, each class counting alike: halfway between the two values it parts."""
    order = np.argsort(mean, kind="stable")
    x, y = mean[order], good[order].astype(float)
    miss = np.append(0, np.cumsum(y)) / max(1, y.sum()) + (1 - np.append(0, np.cumsum(1 - y)) / max(1, (1 - y).sum()))
    edge = np.concatenate([[x[0] - 1e-6], (x[1:] + x[:-1]) / 2, [x[-1] + 1e-6]])
    at = np.flatnonzero(miss <= miss.min() + 1e-12)
    return float(edge[at[0]])


def train(docs: DataFrame, labels: DataFrame, settings: Settings) -> Importance | None:
    one = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = dict(one.groupBy("quality").count().collect())
    if len(sizes) < 2:
        return None
    found = {c: first_by_hash(one.filter(F.col("quality") == c), settings.seed, "doc_id", settings.rows, sizes[c]) for c in (0, 1)}
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], c, i % settings.folds == 0) for c in (0, 1) for i, r in enumerate(found[c])], f"l_doc {kind(docs, 'doc_id')}, quality int, fits boolean")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_doc")).select("text", "quality", "fits")
    ratio = model(texts.filter("quality = 1 and not fits").select("text"), settings) - model(docs.select("text"), settings)
    plain = Importance(ratio, 0.0)

    def means(batches):
        for b in pieces(batches):
            weight, size = plain.weigh(as_bytes(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(weight / np.maximum(1, size)), b.column(1)], ["x", "y"])

    if settings.keep is not None:
        return plain
    fits = texts.filter("fits").select("text", "quality").mapInArrow(means, "x double, y int").orderBy("x", "y").toArrow().to_pandas()
    return Importance(ratio, best_level(fits["x"].to_numpy(float), fits["y"].to_numpy() == 1) if len(fits) else 0.0)


def _weights(importance: Importance, seed: int):
    def run(batches):
        for b in pieces(batches, 256):
            texts = as_bytes(b.column(1))
            weight, size = importance.weigh(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(weight), pa.array(weight + gumbel(b.column(0).to_pylist(), texts, seed))], ["doc_id", "n_grams", "log_weight", "gumbel_key"])

    return run


def gumbel(ids: list, texts: list[bytes], seed: int) -> np.ndarray:
    """Noise that depends on id and text alone, so that reruns draw the same."""
    u = np.array([(xxhash.xxh64_intdigest(f"{i}\0".encode() + t, seed) + 0.5) / 2**64 for i, t in zip(ids, texts, strict=True)])
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 512) -> float:
    """The k-th largest value, by counts in ever finer bins; equal values share a place."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if low is None or k <= 0:
        return math.inf
    if k >= n:
        return low
    above = 0
    for _ in range(12):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        counts = dict(values.filter(F.col(column).between(low, high)).groupBy(place.alias("p")).count().collect())
        for p in sorted(counts, reverse=True):
            if above + counts[p] >= k:
                break
            above += counts[p]
        inside = values.filter(F.col(column).between(low, high) & (place == p))
        low, high = inside.agg(F.min(column), F.max(column)).first()
        if counts[p] == 1 or low == high:
            break
    return low


def choose(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Importance | None, DataFrame, float]:  # noqa: B008
    """The model, doc_id, n_grams, log_weight and gumbel_key of every row, and the least key that is kept."""
    small_batches(docs.sparkSession)
    importance = train(docs, labels, settings)
    if importance is None:
        nothing = docs.select("doc_id", F.lit(0).cast("bigint").alias("n_grams"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"))
        return None, nothing, -math.inf
    weighed = saved(docs.select("doc_id", "text").mapInArrow(_weights(importance, settings.seed), f"doc_id {kind(docs, 'doc_id')}, n_grams bigint, log_weight double, gumbel_key double"))
    if settings.keep is None:
        k = weighed.filter("log_weight > 0").count()
    else:
        k = round(settings.keep * weighed.count()) if settings.keep < 1 else int(settings.keep)
    return importance, weighed, kth_largest(weighed, "gumbel_key", k, settings.bins)


def rate_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, n_grams, log_weight, gumbel_key and kept of every row; a k beyond the rows keeps all.

    ``labels`` has doc_id and quality (1 good); of several labels of a document the smallest
    counts, others than 0 and 1 and those of unknown or null ids none.  Without labels of
    both classes every row is kept with weight 1.  A text without words (null, empty) has
    weight 1.  Rows equal in id and text have equal keys and stay or go together; an empty
    table gives no rows; only doc_id and text are read.
    """
    _, weighed, least = choose(docs, labels, settings)
    return weighed.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the draw keeps, with all their columns; they are weighed again rather than joined, so no text is shuffled."""
    importance, _, least = choose(docs, labels, settings)
    if importance is None:
        return docs
    doc_id, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def keep(batches):
        for b in pieces(batches, 256):
            texts = as_bytes(b.column(text))
            key = importance.weigh(texts)[0] + gumbel(b.column(doc_id).to_pylist(), texts, settings.seed)
            yield b.filter(pa.array(key >= least))

    return docs.mapInArrow(keep, docs.schema)
