"""What several corpus operators share: checkpoints, joins that no key can slow down, Arrow columns, word bytes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space.
SPACES = b" \t\n\r\x0b\x0c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a table that are broadcast to a join; beyond, it is shuffled.
BROADCAST = 200_000
#: Rows of one key above which a shuffled join deals them out to several tasks, at least; so many keys can be hot, at most.
HOT, HOT_KEYS = 2048, 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; only a local master may do without and gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage is cut, and every later read sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", limit: int = BROADCAST, hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on the column ``key`` of both, however many rows share one key.

    ``table`` has one row a key and, like ``rows``, is a scan or saved, as both are read
    twice.  It is broadcast up to ``limit`` rows; beyond, both are shuffled, and rows of a
    key with over ``hot`` of them, or of none, go to several tasks, to each of which the
    key's row of ``table`` is copied.  ``hot`` grows with the rows, so that few keys are.
    """
    if table.count() <= limit:
        return rows.join(F.broadcast(table), key, how)
    hot = hot or max(HOT, rows.count() // HOT_KEYS)
    often = rows.groupBy(key).count().filter(F.col("count") > hot).select(F.col(key).alias("s_key"), F.ceil(F.col("count") / hot).cast("int").alias("s_blocks"))
    often = saved(often)
    turn = F.pmod(F.monotonically_increasing_id(), F.coalesce("s_blocks", F.when(F.col("s_key_").isNull(), F.lit(256)).otherwise(F.lit(1)))).cast("int")
    dealt = rows.withColumn("s_key_", F.col(key)).join(F.broadcast(often), F.col("s_key_") == F.col("s_key"), "left").withColumn("s_turn", turn).drop("s_blocks", "s_key", "s_key_")
    copies = table.join(F.broadcast(often), F.col(key) == F.col("s_key"), "left")
    copies = copies.withColumn("s_turn", F.explode(F.sequence(F.lit(0), F.coalesce("s_blocks", F.lit(1)) - 1))).drop("s_blocks", "s_key")
    return dealt.join(copies.hint("merge"), [key, "s_turn"], how).drop("s_turn")


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bounds the bytes of an Arrow batch sent to Python, whatever the length of the texts, so that tasks hold little outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that a task holds little at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def first_by_hash(df: DataFrame, seed: int, key: str, n: int, total: int) -> list:
    """About the ``n`` rows (never more) of ``total`` whose key hashes lowest: a bound on the hash lets few others reach the driver."""
    share = min(1.0, (1.2 * n + 100) / max(1, total))
    rows = df.withColumn("first_hash", F.xxhash64(F.lit(seed), key))
    rows = (rows if share == 1 else rows.filter(F.col("first_hash") <= int((2 * share - 1) * 2**63))).collect()
    return sorted(rows, key=lambda r: (r["first_hash"], r[key]))[:n]


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fold(column: Column | str) -> Column:
    """The string with A-Z alone lower-cased."""
    return F.translate(column, UPPER, LOWER)


def bucket5(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))), F.lit(5))
