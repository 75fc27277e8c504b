"""Importance resampling against a plain computation, and a benchmark that is scanned in parts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm.decontam import drop_contaminated, find_contamination
from fleetlens.llm.quality import Settings, best_level, choose, gumbel, keep_good, rate_quality

M = 2**64


def buckets(text, n):
    """Buckets of a text's words and neighbouring pairs."""
    h = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().split()]
    out = Counter(x % n for x in h)
    for a, b in zip(h, h[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 % M) ^ ((b + 0xD1B54A32D192ED03) % M)
        out[(p ^ (p >> 32)) % n] += 1
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) if rng.random() < 0.8 else rng.choice(good + bad) for _ in range(rng.randint(3, 60)))) for i in range(150)]
    rows += [(150, ""), (151, None), (152, "word " * 100_000), (7, "again"), (7, "again"), (None, "no id")]
    labels = [(i, int(i % 3 > 0)) for i in range(120)] + [(5, 0), (None, 1), (6, None), (8, 3)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, log_weight string").repartition(4, "text")
    return rows, docs, spark.createDataFrame(labels, "doc_id bigint, quality int")


def plain(rows, s):
    """Log weights of all rows by plain likelihood ratios, and the mean ratios of the rows that set the level."""
    label = {i: int(i % 3 > 0) for i in range(120)} | {5: 0}
    signed = lambda x: x - M if x >= M // 2 else x
    order = {c: sorted((i for i, q in label.items() if q == c), key=lambda i: (signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), signed_seed(s.seed))), i)) for c in (0, 1)}
    fits = {i: c for c in (0, 1) for k, i in enumerate(order[c]) if k % s.folds == 0}
    target, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t, s.buckets))
        if label.get(i) == 1 and i not in fits:
            target.update(buckets(t, s.buckets))
    log = lambda c, k: math.log((c[k] + s.smoothing) / (sum(c.values()) + s.smoothing * s.buckets))
    weigh = lambda t: (sum(n * (log(target, k) - log(raw, k)) for k, n in buckets(t, s.buckets).items()), sum(buckets(t, s.buckets).values()))
    held = [(weigh(t), fits[i]) for i, t in rows if i in fits]
    return [weigh(t) for _, t in rows], np.array([w / max(1, n) for (w, n), _ in held]), np.array([c for _, c in held])


def near(x):
    return float(f"{x:.7g}")


def signed_seed(seed):
    """Spark's xxhash64 of a literal and a column: the first's hash is the second's seed."""
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)


def test_weights_level_and_draw(tables):
    rows, docs, labels = tables
    s = Settings(buckets=512, folds=3)
    ratios, mean, good = plain(rows, s)
    level = best_level(np.sort(mean), good[np.argsort(mean, kind="stable")] == 1)
    importance, weighed, least = choose(docs, labels, s)
    assert math.isclose(importance.level, level, rel_tol=1e-9)
    want = sorted((str(i), near(w - level * n), n) for (i, _), (w, n) in zip(rows, ratios, strict=True))
    assert sorted((str(r.doc_id), near(r.log_weight), r.n_grams) for r in weighed.collect()) == want
    keys = [w - level * n + gumbel([i], [(t or "").encode()], s.seed)[0] for (i, t), (w, n) in zip(rows, ratios, strict=True)]
    k = sum(w - level * n > 0 for w, n in ratios)
    assert math.isclose(least, sorted(keys, reverse=True)[k - 1], rel_tol=1e-9)
    assert sorted(str(r.doc_id) for r in rate_quality(docs, labels, s).filter("kept").collect()) == sorted(str(i) for (i, _), x in zip(rows, keys, strict=True) if x >= least - 1e-9)


@pytest.mark.parametrize(("keep", "n"), [(20, 20), (0.25, 39), (1000, 156), (0.0, 0)])
def test_a_named_number_of_rows(tables, keep, n):
    rows, docs, labels = tables
    s = Settings(buckets=512, folds=3, keep=keep)
    ratios, _, _ = plain(rows, s)
    kept = [r for r in rate_quality(docs, labels, s).collect() if r.kept]
    keys = sorted((w + gumbel([i], [(t or "").encode()], s.seed)[0] for (i, t), (w, _) in zip(rows, ratios, strict=True)), reverse=True)
    assert abs(len(kept) - n) <= 1  # rows equal in id and text go together
    assert sorted(near(r.gumbel_key) for r in kept) == sorted(near(x) for x in keys[: len(kept)])
    mine = keep_good(docs, labels, s)
    assert mine.columns == docs.columns and mine.count() == len(kept)


def test_gumbel_draws_in_proportion_to_weights():
    texts = [b"a", b"b", b"c"]
    log_weights = np.log([1.0, 2.0, 5.0])
    first = Counter(int(np.argmax(log_weights + gumbel([0, 1, 2], texts, seed))) for seed in range(4000))
    assert all(abs(first[i] / 4000 - w / 8) < 0.03 for i, w in enumerate((1, 2, 5)))


def test_a_benchmark_in_parts_gives_the_same(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(40, None), (41, "")]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randrange(3)):
            w += (rng.choice(items)[1] or "").upper().split()[:14]
        rows.append((i, ", ".join(w) or None, "x"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, find_contamination(docs, benchmark).collect()))
    assert sum("Row(start" in x for x in whole) > 10
    for most in (2000, 700):
        assert sorted(map(str, find_contamination(docs, benchmark, max_bytes=most).collect())) == whole
        assert sorted(map(str, drop_contaminated(docs, benchmark, max_bytes=most).collect())) == sorted(map(str, drop_contaminated(docs, benchmark).collect()))
    assert find_contamination(docs.limit(0), benchmark, max_bytes=700).count() == 0
