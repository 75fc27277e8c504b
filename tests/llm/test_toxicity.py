"""The two Kneser-Ney models against a plain computation of both log-likelihoods."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.decontam import words
from fleetlens.llm.toxicity import Settings, _bigrams, kneser_ney, score_toxicity


def corpus(n=120):
    rng = random.Random(5)
    plain = [f"p{i}" for i in range(12)]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            w[3:3] = rng.choice([["vile"], ["foul", "p1", "p2"], ["p3", "p4", "p5"]])
        out.append((" ".join(w), int(i % 3 == 0)))
    return [*out, ("", 0), (None, 1)]


def plain_models(texts, s):
    """log10-free, dictionary-only version: P(w | v) of either class."""
    n = [Counter(), Counter()]
    for text, c in texts:
        w = ["^", *words((text or "").encode())]
        n[c].update(set(zip(w, w[1:], strict=False)))
    both = n[0] + n[1]
    before, f = Counter(w for _, w in both), [Counter(w for _, w in n[c]) for c in (0, 1)]
    every = sum(before.values())
    left = sum(min(x, s.discount) for x in before.values()) / every / (len(before) + 1)
    single = lambda w: left + (max(before[w] - s.discount, 0) / every if w in before else 0)
    after = defaultdict(lambda: [0, 0])
    for c in (0, 1):
        for (v, _), x in n[c].items():
            after[v][c] += x

    def shared(v, w):
        total = sum(after[v]) if v in after else 0
        if not total:
            return single(w)
        off = sum(min(x, s.discount) for (a, _), x in both.items() if a == v)
        return max(both[v, w] - s.discount, 0) / total + off / total * single(w)

    beyond = lambda x, due: max(x - s.margin * due - s.deviations * math.sqrt(1 + due), 0)
    total = [sum(f[c].values()) for c in (0, 1)]
    own = [{w: beyond(f[c][w], total[c] * (f[1 - c][w] + 1) / total[1 - c]) / total[c] for w in before} for c in (0, 1)]

    def low(c, v, w):
        return own[c].get(w, 0) + (1 - sum(own[c].values())) * shared(v, w)

    def phrase(c, v, w):
        return beyond(n[c][v, w], after[v][c] * low(c, v, w)) / after[v][c] if n[c][v, w] else 0

    def p(c, v, w):
        kept = 1 - sum(phrase(c, v, x) for a, x in n[c] if a == v)
        return phrase(c, v, w) + kept * low(c, v, w)

    return p, list(before)


@pytest.mark.parametrize("settings", [Settings(deviations=0.5, margin=1.0), Settings(deviations=0.2, margin=1.5, discount=0.5)])
def test_ratio_is_the_difference_of_both_log_likelihoods(spark, settings):
    texts = corpus()
    pairs = spark.createDataFrame(texts, "text string, toxic int").repartition(3).mapInArrow(_bigrams, "toxic int, first bigint, second bigint, n bigint")
    counted = pairs.groupBy("first", "second").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    model = kneser_ney(counted, settings)
    p, vocabulary = plain_models(texts, settings)
    for v in ("^", "p1", "vile", "never seen"):  # both are distributions, with one unknown word
        assert all(math.isclose(sum(p(c, v, w) for w in [*vocabulary, "unknown"]), 1, rel_tol=1e-9) for c in (0, 1))
    asked = [t for t, _ in texts[:9]] + ["vile vile p3 p4 p5", "new words only", "foul p1 p2 new", ""]
    got = model.ratio([t.encode() for t in asked])
    assert model.own.any() and model.phrase.any() and len({round(x, 9) for x in got}) > 5
    for t, x in zip(asked, got, strict=True):
        w = ["^", *words(t.encode())]
        logs = [sum(math.log(p(c, a, b)) for a, b in zip(w, w[1:], strict=False)) for c in (0, 1)]
        assert math.isclose((logs[1] - logs[0]) / max(1, len(w) - 1), x, rel_tol=1e-9, abs_tol=1e-12)


def test_repeats_long_texts_and_bounds(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([*(rng.choice("abcdefgh") for _ in range(30)), *(["vile"] * 3 if i % 4 == 0 else [])])) for i in range(400)]
    rows += [(1000, "a vile b vile " * 25_000), (1001, "a b c d " * 50_000), *[(1002, "a vile text") for _ in range(3)], (None, "vile"), (None, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(1002, 1), (None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, score string, ratio double")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] > 0.9 and by_id[1001] < 0.5
    assert len({r.score for r in got if r.doc_id == 1002}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([(by_id[i] >= 0.5) == (i % 4 == 0) for i in range(400)]) > 0.97
    assert {r.score for r in score_toxicity(docs, labels, F.lit(True), Settings(max_bytes=10)).collect()} == {0.0}
