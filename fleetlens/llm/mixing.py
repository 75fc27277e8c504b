"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, its source's
target divided by its source's size.  The whole part is taken for certain; the
fraction is decided by balanced sampling.  The flight phase moves the fractions of
three documents at a time along the null space of the two balancing constraints
(words, documents), so both totals stay exact, until at most two fractions are left.
Flights run in blocks of about a thousand documents of one source and what they leave
flies again in ever fewer blocks.  The last flight of a source spares a dozen of its
documents, from the largest to the smallest; with the two it leaves they make the
landing problem, solved by trying every choice.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, kind, pieces, saved, small_batches

#: Documents of a block; how many blocks one flight of the next level takes up; fractions that count as whole.
BLOCK, SHRINK, EPS = 1000, 400, 1e-9
#: Documents that a source's last flight leaves for its landing.
LANDING = 12


def _count_words(batches):
    for b in pieces(batches):
        sizes = [len(x.split()) for x in as_bytes(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words, split at ASCII white space only."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(_count_words, f"doc_id {kind(docs, 'doc_id')}, source string, size bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: its size, documents and target.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times
    all words; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight.  Capped sources are the first ones by cap per weight; as they are
    set aside the level of the others rises, and falls once one is that isn't capped, so
    the level sought is the largest over the running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - spent("cap")) / (F.sum("weight").over(whole) - spent("weight")))
    return per.withColumn("target", F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight"))).select("source", "source_size", "source_docs", "target")


def flight(sizes: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """Moves ``probs`` to 0 or 1 while both their sum and their sum weighted by ``sizes`` stay; at most two stay fractional."""
    p, live = list(probs), []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1, -1, 0)
            up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(live, u, strict=True) if v)
            down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(live, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            for k, v in zip(live, u, strict=True):
                p[k] += step * v
                if p[k] < EPS:
                    p[k] = 0.0
                elif p[k] > 1 - EPS:
                    p[k] = 1.0
            live = [k for k in live if 0 < p[k] < 1]
    return p


def land(sizes: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """Rounds the few fractions left (at most ``LANDING + 2``) by the choice that misses the words, then the documents, least; ties fall by lot."""
    open_ = [i for i, x in enumerate(probs) if 0 < x < 1]
    if not open_:
        return probs
    s, p = np.array([sizes[i] for i in open_], float), np.array([probs[i] for i in open_])
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    miss = np.abs(choices @ s - s @ p) / max(1.0, s.mean()) + 0.02 * np.abs(choices.sum(axis=1) - p.sum())
    best = choices[rng.choice(np.flatnonzero(miss <= miss.min() + EPS).tolist())]
    out = list(probs)
    for i, x in zip(open_, best.tolist(), strict=True):
        out[i] = float(x)
    return out


def _fly(level: int, seed: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        first = rows.iloc[0]
        rng = random.Random(xxhash.xxh64_intdigest(repr((seed, level, first["source"], int(first["block"]))).encode()))
        sizes = [int(x) for x in rows["size"]]
        p = [float(x) for x in rows["p"]]
        if first["blocks"] > 1:
            return rows.assign(p=flight(sizes, p, rng))
        open_ = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
        kept = {open_[round(j * (len(open_) - 1) / (LANDING - 1))] for j in range(LANDING)} if open_ else set()
        flown = iter(flight([x for i, x in enumerate(sizes) if i not in kept], [x for i, x in enumerate(p) if i not in kept], rng))
        return rows.assign(p=land(sizes, [x if i in kept else next(flown) for i, x in enumerate(p)], rng))

    return one


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to ``most`` rounded up) of every document.

    Null texts have size 0, null is a source of its own (the last), an empty table gives
    no rows, and columns other than doc_id, source and text are not read.  Blocks and
    random numbers depend on the rows alone, so reruns agree; rows equal in id and
    size are exchangeable.
    """
    small_batches(docs.sparkSession)
    sizes = saved(word_sizes(docs))
    targets = saved(source_targets(sizes, weights, share, most))
    largest = targets.agg(F.max("source_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    t = targets.withColumn("ratio", ratio).withColumnRenamed("source", "t_source")
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).select(
        "doc_id", "source", "size", "source_size", "target", F.floor("ratio").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"),
        F.ceil(F.col("source_docs") / BLOCK).alias("blocks"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("source_docs") / BLOCK)).alias("block"),
    )
    done, level = [], 0
    while True:
        rows = saved(rows.groupBy("source", "block").applyInPandas(_fly(level, seed), rows.schema))
        done.append(rows.filter("p = 0 or p = 1"))
        if largest <= BLOCK * SHRINK**level:
            break
        rows = rows.filter("p > 0 and p < 1").withColumns({"block": F.floor(F.col("block") / SHRINK), "blocks": F.ceil(F.col("blocks") / SHRINK)})
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("int").alias("copies"))
