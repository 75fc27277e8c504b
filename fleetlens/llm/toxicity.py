"""Toxicity by two class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated model of its own:

    P(w | v) = A(v, w) + kept(v) * (U(w) + rest * B(w | v))

A are the class's discounted bigrams and kept(v) the backoff weight that their discounts
leave; U are its discounted unigrams, over counts of distinct words before a word, and
rest the weight that these discounts leave.  Both back off to the same B, a Kneser-Ney
bigram model of the counts of both classes together, so a rare expression is smoothed
alike in either class and by itself speaks for none.

A class's count is discounted by what the other class (for a word) or the lower order
(for a pair) lets expect, ``margin`` times, and ``deviations`` standard deviations more: an
absolute discount would leave the chance counts of a small labelled sample, whose sum
over a text drowns the few words that tell.  Pairs are counted once a text, so copied
lines and repetitions inside a text count once.

A text's score is the difference of its two log-likelihoods over its number of words, put
between 0 and 1 by a logistic curve fitted on labelled rows that the counts have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, first_by_hash, kind, pieces, saved, small_batches
from .decontam import words

#: Hash that stands before the first word.
START = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Settings:
    """What is learnt from, and how counts are discounted.

    At most ``rows`` labelled rows a class are read, first by hash, and of these as many as
    fit into ``max_bytes`` of text; one in ``folds`` fits the curve.  ``discount`` is taken off the
    counts of the shared model; ``margin`` and ``deviations`` discount those of a class.
    """

    rows: int = 3000
    max_bytes: int = 256 << 20
    folds: int = 8
    discount: float = 0.75
    margin: float = 2.0
    deviations: float = 4.0


def hashed(text: bytes) -> np.ndarray:
    """Hashes of a text's words, after one that marks the start."""
    return np.array([START, *map(xxhash.xxh64_intdigest, words(text))], np.uint64)


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first >> np.uint64(29)))


def _bigrams(batches):
    """toxic, first, second, n: texts that hold a pair of neighbours, a few hundred texts at a time."""
    for b in pieces(batches):
        found: Counter = Counter()
        for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            h = hashed(text).view(np.int64).tolist()
            found.update({(toxic, x, y) for x, y in zip(h, h[1:], strict=False)})
        if found:
            toxic, first, second = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(list(found.values()), pa.int64())],
                ["toxic", "first", "second", "n"],
            )


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in a sorted table; its length where a value is not in it."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, len(table))


@dataclass
class Model:
    """Both classes' models; rows of two are the ordinary and the toxic class, the last entry of a table stands for what is not in it.

    By word hash: ``shared`` unigrams, ``backoff`` (the shared model's weight after a word), ``own``
    (U) and ``kept``.  By pair hash: ``joint`` (the shared model's discounted share) and
    ``phrase`` (A); of pairs without a share of either class only those are listed that
    end in a word which a class has a share of, as the others cancel.
    """

    words: np.ndarray
    shared: np.ndarray
    backoff: np.ndarray
    own: np.ndarray
    kept: np.ndarray
    pairs: np.ndarray
    joint: np.ndarray
    phrase: np.ndarray
    slope: float = 1.0
    middle: float = 0.0

    def ratio(self, texts: list[bytes]) -> np.ndarray:
        """log P(text | toxic) - log P(text | ordinary) over the number of words; 0 without words."""
        hashes = [hashed(t) for t in texts]
        size = np.array([len(h) for h in hashes], np.int64)
        if not len(size):
            return np.zeros(0)
        h = np.concatenate(hashes)
        starts = np.cumsum(size) - size
        at = find(self.words, h)
        word = np.ones(len(h), bool)
        word[starts] = False  # a start mark is not a word
        i = np.flatnonzero(word)
        first, second = at[i - 1], at[i]
        both = find(self.pairs, pair(h[i - 1], h[i]))
        back = self.joint[both] + self.backoff[first] * self.shared[second]
        rest = 1 - self.own.sum(axis=1)
        p = [self.phrase[c][both] + self.kept[c][first] * (self.own[c][second] + rest[c] * back) for c in (0, 1)]
        value = np.zeros(len(h))
        value[i] = np.log(p[1]) - np.log(p[0])
        return np.add.reduceat(value, starts) / np.maximum(1, size - 1)

    def score(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (ratio - self.middle), -30, 30)))


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded result, word hashes as unsigned numbers."""
    found = df.select(*names).toArrow()
    return [found.column(n).to_numpy().view(np.uint64) if n in ("first", "second") else found.column(n).to_numpy().astype(float) for n in names]


def kneser_ney(bigrams: DataFrame, settings: Settings) -> Model:
    """From distinct pairs (first, second) and the numbers n0 and n1 of ordinary and toxic texts that hold them.

    The driver gets a row a word, and the pairs that a class may have a share of or that
    end in such a word; all of it is bounded by the labelled rows' text.
    """
    beyond = lambda n, due: np.maximum(n - settings.margin * due - settings.deviations * np.sqrt(1 + due), 0)
    both = F.col("n0") + F.col("n1")
    ends = bigrams.groupBy("second").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(f"n{c}") > 0).alias(f"f{c}") for c in (0, 1)])
    starts = bigrams.groupBy("first").agg(F.sum("n0").alias("after0"), F.sum("n1").alias("after1"), F.sum(F.least(both, F.lit(settings.discount))).alias("off"))
    word, every, f0, f1 = columns(ends, "second", "all", "f0", "f1")
    first, after0, after1, off = columns(starts, "first", "after0", "after1", "off")
    table = np.union1d(word, first)
    place = lambda values: find(table, values)
    n = len(table)

    cut = np.minimum(every, settings.discount)
    shared = np.full(n + 1, cut.sum() / every.sum() / (len(word) + 1))
    shared[place(word)] += (every - cut) / every.sum()
    backoff, after = np.ones(n + 1), np.zeros((2, n + 1))
    after[:, place(first)] = after0, after1
    backoff[place(first)] = off / (after0 + after1)

    own, f = np.zeros((2, n + 1)), np.stack([f0, f1])
    total = np.maximum(1.0, f.sum(axis=1))
    for c in (0, 1):
        own[c, place(word)] = beyond(f[c], total[c] * (f[1 - c] + 1) / total[1 - c]) / total[c]
    rest = 1 - own.sum(axis=1)

    telling = bigrams.sparkSession.createDataFrame([(int(x),) for x in table[np.flatnonzero(own[:, :-1].any(axis=0))].view(np.int64)], "t_word bigint")
    listed = bigrams.join(F.broadcast(telling), F.col("second") == F.col("t_word"), "left").filter(F.col("t_word").isNotNull() | (F.greatest("n0", "n1") > settings.deviations))
    v, w, n0, n1 = columns(listed, "first", "second", "n0", "n1")
    counts, a, b = np.stack([n0, n1]), place(v), place(w)
    joint = np.maximum(n0 + n1 - settings.discount, 0) / np.maximum(1, after[:, a].sum(axis=0))
    back = joint + backoff[a] * shared[b]
    phrase, kept = np.zeros((2, len(v))), np.ones((2, n + 1))
    for c in (0, 1):
        due = after[c, a] * (own[c, b] + rest[c] * back)
        phrase[c] = np.where(counts[c] > 0, beyond(counts[c], due) / np.maximum(1, after[c, a]), 0)
        np.subtract.at(kept[c], a, phrase[c])
    keys = pair(v, w)
    order = np.argsort(keys)
    last = lambda x: np.concatenate([x[..., order], np.zeros((*x.shape[:-1], 1))], axis=-1)
    return Model(table, shared, backoff, own, np.maximum(kept, 1e-9), keys[order], last(joint), last(phrase))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and middle of the curve, with class 1 weighing ``prior`` of the whole, by Newton's method on the standardised ratio."""
    if not len(x) or y.min() == y.max() or x.std() == 0:
        return 1.0, 0.0
    mean, sd = x.mean(), x.std()
    z, weight = np.stack([np.ones_like(x), (x - mean) / sd]), np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        slope = z @ (weight * (y - p)) - 1e-3 * w
        w = w + np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-9))) @ z.T + 1e-3 * np.eye(2), slope)
    return (w[1] / sd, mean - w[0] / w[1] * sd) if w[1] > 0 else (1.0, 0.0)


def labelled_texts(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, float] | None:
    """text, toxic and fits of the rows that are learnt, written to the checkpoint folder, and the weight of the toxic class; None if either class has no row."""
    one = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(one.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    found = {c: first_by_hash(one.filter(F.col("toxic") == c), 3, "doc_id", settings.rows, sizes[c]) for c in (0, 1)}
    share = sizes[1] / (sizes[0] + sizes[1])
    share = 1 / (1 + math.sqrt((1 - share) / share))  # halfway, on the scale of odds, between the classes' share and equal weight
    picked = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["toxic"], i, i % settings.folds == 0) for c in (0, 1) for i, r in enumerate(found[c])],
        f"l_doc {kind(docs, 'doc_id')}, toxic int, turn int, fits boolean",
    )
    texts = saved(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_doc")).select("text", "toxic", "turn", "fits"))
    room, last = settings.max_bytes, settings.rows  # a turn is a row of each class; repeated rows of a document share its turn
    for turn, size in texts.groupBy("turn").agg(F.sum(F.octet_length("text"))).orderBy("turn").collect():
        room -= size or 0
        if room < 0:
            last = turn
            break
    return texts.filter(F.col("turn") < last), share


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:  # noqa: B008
    """A model of ``labels`` (doc_id, toxic) over ``docs``; None if either class has no row."""
    picked = labelled_texts(docs, labels, settings)
    if picked is None:
        return None
    texts, share = picked
    counted = texts.filter("not fits").select("text", "toxic").mapInArrow(_bigrams, "toxic int, first bigint, second bigint, n bigint")
    bigrams = saved(counted.groupBy("first", "second").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]))
    if bigrams.isEmpty():
        return None
    model = kneser_ney(bigrams, settings)

    def ratios(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.ratio(as_bytes(b.column(0)))), b.column(1)], ["x", "y"])

    fitted = texts.filter("fits").select("text", "toxic").mapInArrow(ratios, "x double, y int").orderBy("x", "y").toArrow().to_pandas()
    model.slope, model.middle = fit_logistic(fitted["x"].to_numpy(float), fitted["y"].to_numpy(float), share)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, ratio (difference of the length-normalised log-likelihoods) and score (0 to 1) of every row.

    ``learn_from`` is a condition on ``labels``' doc_id.  Of several labels of a document the
    largest counts, labels other than 0 and 1 and those of unknown or null ids none; of a
    document with repeated rows each is learnt.  A text without words (null, empty) has
    ratio 0; without labels of both classes, or words in the texts that are learnt, every
    score is 0.  Equal texts have equal scores, whatever their length.  An empty table gives
    no rows; only doc_id and text are read, and no other column comes back.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels.filter(learn_from).select("doc_id", "toxic"), settings)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("ratio"), F.lit(0.0).alias("score"))

    def run(batches):
        for b in pieces(batches, 128):
            x = model.ratio(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(model.score(x))], ["doc_id", "ratio", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, ratio double, score double")
