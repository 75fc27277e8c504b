"""A hidden Markov language model over the whole vocabulary.

Frequent tokens have emissions of their own; all others share classes by hash, inside which
a token has its smoothed share of the class's count, with a share for unknown tokens.  So
the model is a proper distribution over an open vocabulary, the recursions run over small
class numbers, and what depends on a rare token's own count is a sum that a join with the
counts of all tokens supplies, however many there are.

Baum-Welch starts from random emissions around the overall ones.  Its first rounds read
shares of the training documents that grow from round to round, the following ones all of
them, until the likelihood gains no more than a tolerance: tasks add up expected counts, a
shuffle sums them by class, and the driver receives one row a class.  Scores are exact
sequence likelihoods by the scaled forward recursion, run over many documents at a time;
long documents are worked in strides, from the forward values kept at their edges.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, kind, pieces, saved, small_batches

#: Distinct tokens that a task holds before it hands its counts on.
HELD = 200_000
#: Tokens whose sequences are padded and processed together: documents times longest length.
CELLS = 1 << 17
#: Tokens of sequences that a task gathers, so that documents of like length go together.
GATHERED = 1 << 21
#: Steps of a recursion whose values are held at once.
STRIDE = 1 << 16
#: Bytes of a text that are split at once, and bytes above which a token is told by its digest.
SPLIT, LONG = 1 << 23, 64
#: Classes that rare tokens share; a power of two.
SHARED = 2048


@dataclass(frozen=True)
class Settings:
    """Sizes of the model, and how long it learns.

    ``states``; at most ``classes`` tokens have own emissions and ``listed`` tokens travel to
    tasks with their counts (the most frequent ones); the counts of all others are joined.
    ``shares`` of the training documents, of ``least`` documents where there are as many, are
    read in the first rounds; then up to ``rounds`` rounds read all, until one gains less than
    ``tolerance`` in log10 a token.  ``prior`` counts of the overall distribution are added in
    each state, ``pooled`` counts of all shared classes to each of them.
    """

    states: int = 8
    classes: int = 50_000
    listed: int = 250_000
    shares: tuple[float, ...] = (1 / 64,) * 8 + (1 / 8,)
    least: int = 1000
    rounds: int = 2
    tolerance: float = 0.002
    prior: float = 20.0
    pooled: float = 100_000.0
    seed: int = 5


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The folded words of a text, those of a few megabytes at a time."""
    at = 0
    while len(text) - at > SPLIT:
        cut = max(text.rfind(bytes([c]), at + 1, at + SPLIT) for c in SPACES)
        if cut < 0:  # one word of many megabytes
            cut = min((x for c in SPACES if (x := text.find(bytes([c]), at + 1)) >= 0), default=len(text))
        yield text[at:cut].lower().split()
        at = cut
    yield text[at:].lower().split()


def token_key(word: bytes) -> bytes:
    """A word, or what tells a long one: a space, which no word has, and its digest."""
    return word if len(word) <= LONG else b" " + hashlib.md5(word, usedforsecurity=False).digest()


def _count(batches):
    found: Counter[bytes] = Counter()

    def out():
        for w in [w for w in found if len(w) > LONG]:
            found[token_key(w)] += found.pop(w)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    for b in batches:
        for text in as_bytes(b.column(0)):
            for block in word_blocks(text):
                found.update(block)
                if len(found) > HELD:
                    yield out()
                    found.clear()
    if found:
        yield out()


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (binary, its key) and c, over all texts."""
    return docs.select("text").mapInArrow(_count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("c"))


def step() -> Column:
    """Counts are looked at in steps of a tenth."""
    return F.floor(F.log("c") / math.log(1.1))


def shared_class(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 42) % SHARED


@dataclass
class Vocabulary:
    """Listed tokens in order of count, with the totals that smoothing needs."""

    tokens: list[bytes]
    counts: np.ndarray
    ends: int
    total: int
    distinct: int
    classes: int
    listed_below: int
    shared: np.ndarray  # smoothed counts of the tokens of each shared class, unknown ones included
    filed: np.ndarray  # the shared class of each listed token

    @property
    def end(self) -> int:
        return self.classes + SHARED

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def own(self) -> np.ndarray:
        """Smoothed counts of the classes' tokens."""
        return self.counts[: self.classes] + 0.5

    def overall(self) -> np.ndarray:
        """The smoothed distribution over own classes, shared ones and the end; each shared class has an unknown token."""
        counts = np.concatenate([self.own, self.shared, [self.ends + 0.5 if self.ends else 1e-300]])
        return counts / counts.sum()


def vocabulary(counts: DataFrame, ends: int, settings: Settings) -> Vocabulary:
    """Collects the tokens at or above the least count at which at most ``listed`` remain, and sums by shared class."""
    steps = counts.groupBy(step().alias("s")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    total, distinct = sum(r["n"] for r in steps) + ends, sum(r["v"] for r in steps) + bool(ends)
    least, room = None, settings.listed
    for r in sorted(steps, key=lambda r: -r["s"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["s"]
    listed = counts.filter(step() >= least).toArrow().to_pandas().sort_values(["c", "token"], ascending=[False, True]) if least is not None else None
    tokens = [bytes(t) for t in listed["token"]] if listed is not None else []
    number = listed["c"].to_numpy(float) if listed is not None else np.zeros(0)
    below = 1 + max((r["s"] for r in steps if least is None or r["s"] < least), default=-1)
    classes = min(settings.classes, len(tokens))
    shared = np.full(SHARED, 0.5)
    by_class = counts.groupBy(F.pmod(F.xxhash64("token"), F.lit(SHARED)).cast("int").alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m"))
    for k, m in by_class.collect():  # at most as many as there are shared classes
        shared[k] += m
    filed = np.array([shared_class(t) for t in tokens], np.int64)
    np.subtract.at(shared, filed[:classes], number[:classes] + 0.5)
    return Vocabulary(tokens, number, ends, total, distinct, classes, below, np.maximum(shared, 0.5), filed)


def _encode(v: Vocabulary):
    def run(batches):
        number = {t: i for i, t in enumerate(v.tokens)}
        logs = np.append(np.log10(v.counts + 0.5), 0.0)  # the last is for tokens not listed
        masses = np.log10(v.shared)
        classes, digest = np.append(v.filed, 0), xxhash.xxh64_intdigest
        unlisted, end_log = len(v.tokens), math.log10(v.ends + 0.5)
        for b in pieces(batches, 256):
            n, known, own_log, rare_log, mass_log, ids, tails = [], [], [], [], [], [], []
            for text in as_bytes(b.column(3)):
                words, found, sums, parts, tail = 0, 0, np.zeros(3), [], []
                for block in word_blocks(text):
                    at = np.array([number.get(w, unlisted) for w in block], np.int64)
                    where = np.flatnonzero(at == unlisted).tolist()
                    for i in [i for i in where if len(block[i]) > LONG]:
                        block[i] = token_key(block[i])
                        at[i] = number.get(block[i], unlisted)
                    there = at == unlisted
                    new = [block[i] for i in np.flatnonzero(there).tolist()]
                    value, among = logs[at], classes[at]
                    among[there] = [digest(w, 42) % SHARED for w in new]  # as shared_class
                    rare = at >= v.classes
                    sums += (value[~rare].sum(), value[rare].sum(), masses[among[rare]].sum())
                    parts.append(np.where(rare, v.classes + among, at).astype(np.uint16))
                    tail += new
                    words += len(block)
                    found += len(block) - len(new)
                n.append(words + 1)
                known.append(found + (v.ends > 0))
                own_log.append(float(sums[0]) + end_log)
                rare_log.append(float(sums[1]))
                mass_log.append(float(sums[2]))
                ids.append(np.append(np.concatenate(parts), np.uint16(v.end)).astype(np.uint16).tobytes())
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(own_log), pa.array(rare_log), pa.array(mass_log), pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.binary()))],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "own_log", "rare_log", "mass_log", "ids", "tail"],
            )

    return run


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row a class, a column a state


def _packs(sequences: list[np.ndarray]):
    """Groups of sequences by falling length: their numbers, and how many go on at each step with the padded classes."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        pack = order[at : at + max(1, min(1024, CELLS // longest))]
        at += len(pack)
        ids = np.zeros((longest, len(pack)), np.int64)
        lengths = np.array([len(sequences[i]) for i in pack])
        for j, i in enumerate(pack):
            ids[: lengths[j], j] = sequences[i]
        yield pack, ids, len(pack) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")


def forward(model: Model, ids: np.ndarray, live: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, scaled forward values and scales of a pack, going on from the values ``before``; sequences that have ended keep scale 1."""
    e = model.emit[ids]
    alpha, scale = np.zeros_like(e), np.ones(ids.shape)
    for t in range(len(ids)):
        k = live[t]
        last = alpha[t - 1, :k] if t else before if before is None else before[:k]
        x = (model.start if last is None else last @ model.move) * e[t, :k]
        s = x.sum(axis=1)
        scale[t, :k] = s
        alpha[t, :k] = x / s[:, None]
    return e, alpha, scale


def strides(steps: int) -> list[tuple[int, int]]:
    return [(a, min(a + STRIDE, steps)) for a in range(0, steps, STRIDE)]


def likelihoods(model: Model, ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence of a pack."""
    total, before = np.zeros(ids.shape[1]), None
    for a, b in strides(len(ids)):
        _, alpha, scale = forward(model, ids[a:b], live[a:b], before)
        total, before = total + np.log10(scale).sum(axis=0), alpha[-1].copy()
    return total


def expected(model: Model, sequences: list[np.ndarray], into: Model) -> float:
    """Adds the expected counts of the sequences to ``into``; returns their log10 likelihood.

    Forward values are kept at the edges of strides only and made again, stride by stride, on the way back.
    """
    classes, states, total = *model.emit.shape, 0.0
    for _, ids, live in _packs(sequences):
        cuts, befores = strides(len(ids)), [None]
        for a, b in cuts:
            e, alpha, scale = forward(model, ids[a:b], live[a:b], befores[-1])
            total += float(np.log10(scale).sum())
            befores.append(alpha[-1].copy())
        ahead = None  # what the step after the stride says of its last
        for i in range(len(cuts) - 1, -1, -1):
            a, b = cuts[i]
            if i < len(cuts) - 1:
                e, alpha, scale = forward(model, ids[a:b], live[a:b], befores[i])
            beta = np.ones_like(e)
            for t in range(b - a - 1, -1, -1):
                if t < b - a - 1:
                    k = live[a + t + 1]
                    ahead = e[t + 1, :k] * beta[t + 1, :k] / scale[t + 1, :k, None]
                if ahead is not None:
                    k = len(ahead)
                    beta[t, :k] = ahead @ model.move.T
                    into.move += model.move * (alpha[t, :k].T @ ahead)
            there = np.arange(ids.shape[1])[None, :] < live[a:b, None]
            gamma, flat = (alpha * beta)[there], ids[a:b][there]
            for k in range(states):
                into.emit[:, k] += np.bincount(flat, gamma[:, k], minlength=classes)
            ahead = e[0, : live[a]] * beta[0, : live[a]] / scale[0, : live[a], None]
        into.start += (alpha[0] * beta[0]).sum(axis=0)
    return total


def _empty(model: Model) -> Model:
    return Model(np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit))


def reestimated(counts: Model, overall: np.ndarray, settings: Settings) -> Model:
    """Probabilities of the counts.  A shared class has states of its own as far as its counts go beyond ``pooled``, else those of all shared classes: few of its tokens come again."""
    states = len(counts.start)
    emit = counts.emit + settings.prior * overall[:, None]
    rare = emit[-1 - SHARED : -1]
    each = rare.sum(axis=1, keepdims=True)
    emit[-1 - SHARED : -1] = each * (rare + settings.pooled * rare.sum(axis=0) / rare.sum()) / (each + settings.pooled)
    move = counts.move + 1.0 / states
    start = counts.start + 1.0 / states
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_guess(overall: np.ndarray, settings: Settings) -> Model:
    """Random emissions around the overall ones, and states that mostly stay."""
    rng = np.random.default_rng(settings.seed)
    emit = overall[:, None] * rng.uniform(0.3, 1.7, (len(overall), settings.states))
    move = np.full((settings.states, settings.states), 0.1 / settings.states) + 0.9 * np.eye(settings.states)
    return Model(np.full(settings.states, 1.0 / settings.states), move, emit / emit.sum(axis=0))


def _gathered(batches, column: int):
    """Rows' sequences, a few million tokens at a time, with the batches that they are from."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(x) for x in b.column(column).to_pylist()) // 2
        if size > GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sequences(held, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for b in held for x in b.column(column).to_pylist()]


def _learn(model: Model):
    states = len(model.start)

    def run(batches):
        counts, tokens, gained = _empty(model), 0, 0.0
        for held in _gathered(batches, 0):
            sequences = _sequences(held, 0)
            gained += expected(model, sequences, counts)
            tokens += sum(map(len, sequences))
        if tokens:
            used = np.flatnonzero(counts.emit.any(axis=1))
            rows = np.concatenate([used, -1 - np.arange(states), [-1 - states, -2 - states]])  # classes, then moves by state, the start, and the likelihood
            values = np.concatenate([counts.emit[used], counts.move, counts.start[None, :], np.resize([gained, tokens], (1, states))])
            for i in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 8192].astype(np.int32)), *(pa.array(values[i : i + 8192, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])

    return run


def baum_welch(coded: DataFrame, model: Model, overall: np.ndarray, settings: Settings) -> tuple[Model, float]:
    """One round over all rows of ``coded`` (ids), and the log10 likelihood a token that the model had; without rows the model stays."""
    states = len(model.start)
    columns = [f"s{k}" for k in range(states)]
    rows = coded.select("ids").mapInArrow(_learn(model), f"row int, {', '.join(f'{c} double' for c in columns)}")
    summed = rows.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow().to_pandas()
    if not len(summed):
        return model, 0.0
    counts, mean = _empty(model), 0.0
    at, values = summed["row"].to_numpy(), summed[columns].to_numpy()
    counts.emit[at[at >= 0]] = values[at >= 0]
    for row, value in zip(at[at < 0].tolist(), values[at < 0], strict=True):
        if -1 - row < states:
            counts.move[-1 - row] = value
        elif -1 - row == states:
            counts.start[:] = value
        else:
            mean = value[0] / value[1]
    return reestimated(counts, overall, settings), mean


def learn(coded: DataFrame, documents: int, overall: np.ndarray, settings: Settings) -> Model:
    """Rounds over growing shares of the documents, by the hash of their tokens, then over all until they gain little."""
    model = first_guess(overall, settings)
    for share in settings.shares:
        share = max(share, min(1.0, settings.least / max(1, documents)))
        some = coded if share >= 1 else coded.filter(F.xxhash64("ids") < int((2 * share - 1) * 2**63))
        model, _ = baum_welch(some, model, overall, settings)
    last = -math.inf
    for _ in range(settings.rounds):
        model, mean = baum_welch(coded, model, overall, settings)
        if mean - last < settings.tolerance:
            break
        last = mean
    return model


def _score(model: Model):
    def run(batches):
        for held in _gathered(batches, 0):
            sequences = _sequences(held, 0)
            out = np.zeros(len(sequences))
            for pack, ids, live in _packs(sequences):
                out[pack] = likelihoods(model, ids, live)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), pa.array(out[at : at + b.num_rows])], [*b.schema.names[1:], "hmm"])
                at += b.num_rows

    return run


def score_documents(docs: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Tokens are words between ASCII white space, A-Z folded, and one end a text; null counts
    as empty.  Rows where ``held_out`` is not true train the model, each as often as it is
    repeated.  Without any training row every token is unknown and both scores are 0 by
    the smoothing; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = rows.filter("not held_out")
    counts = saved(count_tokens(training))
    v = vocabulary(counts, training.count(), settings)
    schema = f"rid bigint, doc_id {kind(docs, 'doc_id')}, held_out boolean, n_tokens bigint"
    coded = saved(rows.mapInArrow(_encode(v), f"{schema}, known bigint, own_log double, rare_log double, mass_log double, ids binary, tail array<binary>"))
    tail = (
        coded.select("rid", F.explode("tail").alias("token"))
        .join(counts.filter(step() < v.listed_below), "token", "left")
        .groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t_log"), F.count("c").alias("t_known")).withColumnRenamed("rid", "t_rid")
    )
    model = learn(coded.filter("not held_out"), v.ends, v.overall(), settings) if v.ends else first_guess(v.overall(), settings)
    names = "rid doc_id held_out n_tokens known own_log rare_log mass_log".split()
    scored = coded.select("ids", *names).mapInArrow(_score(model), f"{schema}, known bigint, own_log double, rare_log double, mass_log double, hmm double")
    rare = F.col("rare_log") + F.coalesce("t_log", F.lit(0.0))
    base = F.col("own_log") + rare - F.col("n_tokens") * math.log10(v.mass)
    inside = rare - F.col("mass_log")  # tokens' shares of their classes
    return scored.join(tail, scored["rid"] == tail["t_rid"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (F.col("hmm") + inside if v.ends else base).alias("score"),
    )
