"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each partition of the table hashes its folded texts, sorts the truncated hashes,
   and sends each owner of a hash range one Golomb-Rice-coded list.
2. An owner merges its lists and answers each with a bitmap of the entries that
   occur elsewhere.
3. Only rows whose bit is set (or whose hash repeats inside the partition) send
   their text, and grouping by the text itself verifies them byte by byte.

Hashes cost a few bytes a row, and texts stay where they are but for the suspects;
where these are too many to broadcast their row ids, a merge join picks them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kind, pieces, saved, small_batches, spread_join

#: Truncated hashes have this many bits beyond log2 of the rows: one row in about 2**SPARE is a false suspect.
SPARE = 10
#: Hashes that one owner merges, on average.
OWNED = 4_000_000
#: Suspects whose row ids are broadcast (16 bytes each).
BROADCAST = 2_000_000


def golomb_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sorted distinct values as gaps: quotients by 2**k in unary, then the remainders of k bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(k)) + low, dtype=np.uint64)


def _hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7)


def _fingerprint(batches):
    for b in pieces(batches):
        texts = [x.lower() for x in as_bytes(b.column(2))]  # bytes.lower() changes A-Z alone
        hashes = np.array([_hash(x) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], ["rid", "doc_id", "h", "text_sha256"])


def _to_owners(bits: int, owners: int):
    def send(batches):
        """One Golomb-coded list of a partition's distinct hashes for each owner."""
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        src = int(parts[0][0][0])
        values = np.unique(np.concatenate([h for _, h in parts]).view(np.uint64) >> np.uint64(64 - bits))
        owner = (values * np.uint64(owners)) >> np.uint64(bits)
        for o in np.unique(owner).tolist():
            part = values[owner == o]
            k = max(0, int(math.log2(max(1.0, 2**bits / owners / len(part)))))
            unary, rest = golomb_encode(part - np.uint64(int(o * 2**bits) // owners), k)  # gaps count from where the owner's range begins
            yield pa.RecordBatch.from_pydict({"owner": pa.array([o], pa.int32()), "src": pa.array([src], pa.int64()), "n": pa.array([len(part)], pa.int64()), "k": pa.array([k], pa.int32()), "head": pa.array([unary], pa.binary()), "rest": pa.array([rest], pa.binary())})

    return send


def _own(lists: pd.DataFrame) -> pd.DataFrame:
    """For each list a bitmap of the entries that another list has too."""
    values = [golomb_decode(int(n), int(k), a, b) for n, k, a, b in zip(lists["n"], lists["k"], lists["head"], lists["rest"], strict=True)]
    found, counts = np.unique(np.concatenate(values), return_counts=True)
    twice = found[counts > 1]
    return pd.DataFrame({"owner": lists["owner"], "src": lists["src"], "bitmap": [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in values]})


def _receive(bits: int, owners: int):
    def suspects(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        """The rows of a partition whose hash repeats in it or is marked in an owner's bitmap."""
        hashes = rows["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        values, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        marked, owner = counts > 1, (values * np.uint64(owners)) >> np.uint64(bits)
        for o, bitmap in zip(bitmaps["owner"], bitmaps["bitmap"], strict=True):
            at = np.flatnonzero(owner == o)
            marked[at] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(at)].astype(bool)
        return rows.loc[marked[back], ["rid", "h"]]

    return suspects


def _folded(batches):
    for b in pieces(batches):
        texts = [x.lower() for x in as_bytes(b.column(3))]
        if [_hash(x) for x in texts] != b.column(1).to_numpy().view(np.uint64).tolist():
            raise RuntimeError("the table gave its rows in another order when it was read again; pass stable=False")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.decode() for x in texts], pa.string())], ["rid", "doc_id", "text"])


def exact_duplicates(docs: DataFrame, stable: bool = True) -> DataFrame:
    """rid, doc_id, text_sha256, keep_id, group_size and kept of every row.

    Texts are equal when identical after folding A-Z; null counts as empty.  Of equal
    texts the row with the largest doc_id stays (null ids are the smallest; of repeated
    rows with that id the one with the largest row id stays, so that one row of a group
    is kept).  An empty table gives no rows; other columns are not read.  ``stable``
    says that reading ``docs`` again gives the same partitions, as reading files does;
    otherwise the two columns are written to the checkpoint folder first.  A partition
    whose rows did change is noticed by its hashes and fails the job.
    """
    small_batches(docs.sparkSession)
    schema = f"rid bigint, doc_id {kind(docs, 'doc_id')}"
    docs = docs.select("doc_id", "text")
    docs = docs if stable else saved(docs)
    prints = saved(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(_fingerprint, f"{schema}, h bigint, text_sha256 string"))
    total = prints.count()
    if not total:
        return prints.select("rid", "doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    bits = max(24, math.ceil(math.log2(total)) + SPARE)
    owners = min(65536, max(docs.rdd.getNumPartitions(), math.ceil(total / OWNED)))
    here = prints.select(F.shiftright("rid", 33).alias("src"), "rid", "h")
    lists = here.select("src", "h").mapInArrow(_to_owners(bits, owners), "owner int, src bigint, n bigint, k int, head binary, rest binary")
    bitmaps = lists.groupBy("owner").applyInPandas(_own, "owner int, src bigint, bitmap binary")
    suspects = saved(here.groupBy("src").cogroup(bitmaps.groupBy("src")).applyInPandas(_receive(bits, owners), "rid bigint, h bigint"))
    few = suspects.count() <= BROADCAST
    wanted = suspects.select(F.col("rid").alias("s_rid"), F.col("h").alias("s_h"))
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    texts = texts.join(F.broadcast(wanted) if few else wanted.hint("merge"), F.col("rid") == F.col("s_rid")).select("rid", "s_h", "doc_id", "text")
    suspects = texts.mapInArrow(_folded, f"{schema}, text string")
    groups = (
        suspects.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("keep")).filter("n > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "n", F.col("keep.doc_id").alias("g_keep"), F.col("keep.rid").alias("g_rid"))
    )
    alone = F.col("n").isNull()
    return spread_join(prints, saved(groups), "text_sha256").select(
        "rid", "doc_id", "text_sha256", F.when(alone, F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(F.col("g_rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )
