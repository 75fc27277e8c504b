"""The language model: strides, long words and texts, an open vocabulary that adds up, and gains over the base."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hmm_lm as module
from fleetlens.llm.common import saved
from fleetlens.llm.hmm_lm import Model, Settings, count_tokens, expected, learn, likelihoods, score_documents, shared_class, token_key, vocabulary, word_blocks

SMALL = Settings(states=3, classes=30, listed=45, shares=(0.3, 0.6), least=20, rounds=3)


def topics(n=160):
    """Texts of runs of one of two topics' words, so that what came before tells what comes."""
    rng = random.Random(9)
    own = [[f"a{i}" for i in range(25)], [f"b{i}" for i in range(25)]]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(2, 6)):
            topic = rng.choice(own)
            w += [rng.choice(topic) for _ in range(rng.randint(5, 12))]
        out.append((i, " ".join([*w, f"rare{i}" if i % 3 else "x" * 80 + str(i % 2)])))
    return out


def test_strides_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    sequences = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 2, 3, 7, 8, 9, 16, 17, 40)]
    found = []
    for stride in (1 << 16, 8, 3, 1):
        monkeypatch.setattr(module, "STRIDE", stride)
        counts = Model(np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)))
        total = expected(model, sequences, counts)
        each = np.zeros(len(sequences))
        for pack, ids, live in module._packs(sequences):
            each[pack] = likelihoods(model, ids, live)
        assert math.isclose(each.sum(), total, rel_tol=1e-12)
        found.append(np.concatenate([[total], counts.start, counts.move.ravel(), counts.emit.ravel()]))
    assert all(np.allclose(found[0], x, rtol=1e-10) for x in found[1:])
    assert math.isclose(found[0][1:4].sum(), len(sequences)) and math.isclose(found[0][13:].sum(), sum(map(len, sequences)))


def test_blocks_and_keys(monkeypatch):
    text = b" Some\twords and " + b"y" * 40 + b"\x0bMORE \n words " * 9
    for size in (4, 16, 50, 1 << 23):
        monkeypatch.setattr(module, "SPLIT", size)
        assert [w for block in word_blocks(text) for w in block] == text.lower().split()
    long = [b"z" * 70 + bytes([c]) for c in (48, 49)]
    assert token_key(b"short") == b"short" and len({token_key(w) for w in long}) == 2 and all(len(token_key(w)) == 17 for w in long)


def test_probabilities_of_an_open_vocabulary_add_up(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARED", 4)
    rows = topics()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    counts = saved(count_tokens(docs))
    v = vocabulary(counts, len(rows), SMALL)
    assert math.isclose(v.overall().sum(), 1, rel_tol=1e-9)
    known = sorted({w for _, t in rows for w in t.split()})
    new = {}
    for i in range(100):  # an unknown word of each shared class
        new.setdefault(shared_class(f"new{i}".encode()), f"new{i}")
    assert len(new) == 4
    asked = docs.unionByName(spark.createDataFrame([(1000 + i, w) for i, w in enumerate([*known, *new.values()])], "doc_id int, text string"))
    scored = score_documents(asked, F.col("doc_id") >= 1000, SMALL).filter("doc_id >= 1000").collect()
    coded = saved(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.lit(False).alias("held_out"), "text").mapInArrow(
        module._encode(v), "rid bigint, doc_id int, held_out boolean, n_tokens bigint, known bigint, own_log double, rare_log double, mass_log double, ids binary, tail array<binary>"))
    model = learn(coded, len(rows), v.overall(), SMALL)
    pairs = np.array([[c, v.end] for c in range(v.end)]).T
    one_word = (10 ** likelihoods(model, pairs, np.array([v.end, v.end]))).sum()
    assert math.isclose(sum(10**r.score for r in scored), one_word, rel_tol=1e-6) and 0 < one_word < 1
    assert {r.n_known for r in scored} == {1, 2} and sum(r.n_known == 2 for r in scored) == len(known)


def test_it_learns_and_does_not_depend_on_partitions(spark):
    rows = topics()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    held = F.col("doc_id") % 4 == 0
    found = [{r.doc_id: (r.score, r.base_score, r.n_tokens) for r in score_documents(docs.repartition(n, "text"), held, SMALL).collect()} for n in (1, 5)]
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][i][0], found[1][i][0], rel_tol=1e-6) for i in found[0])
    mine = [v for i, v in found[0].items() if i % 4 == 0]
    assert sum(s - b for s, b, _ in mine) / sum(n for *_, n in mine) > 0.1


@pytest.mark.parametrize("words", [30_000])
def test_a_very_long_text_among_short_ones(spark, monkeypatch, words):
    monkeypatch.setattr(module, "STRIDE", 1 << 12)
    monkeypatch.setattr(module, "SPLIT", 1 << 14)
    rows = [*topics(40), (900, " ".join(f"a{i % 25}" for i in range(words))), (901, None), (901, ""), (901, ""), (None, "z" * 200)]
    got = score_documents(spark.createDataFrame(rows, "doc_id int, text string"), F.col("doc_id") == 5, SMALL).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 900} == {words + 1}
    assert len({r.score for r in got if r.doc_id == 901}) == 1 and all(math.isfinite(r.score) for r in got)
