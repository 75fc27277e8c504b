"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded and hashed once; the hashes are kept in the checkpoint folder, without
text.  Documents per hash are counted after partial aggregation, and the few hashes that
many documents share are joined back so that no frequent line fills a task.  What goes is
told to each document as a list of line numbers, so a text is shuffled once and a line
never.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, kind, pieces, saved, small_batches, spread_join


def _explode(least: int):
    def lines(batches):
        """One row for each long enough key of a document: its hash and the numbers of its lines."""
        for b in pieces(batches):
            at, keys, numbers = [], [], []
            for row, text in enumerate(as_bytes(b.column(2))):
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.lower().split(b"\n")):
                    key = line.strip(SPACES)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                at += [row] * len(found)
                keys += found.keys()
                numbers += found.values()
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.binary()), pa.array(numbers, pa.list_(pa.int32()))], ["l_doc", "l_text", "key", "numbers"])

    return lines


def line_count(text: Column) -> Column:
    """Lines of a text split at newlines; a null or empty text is one empty line."""
    return (F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1).cast("bigint")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` replaced by the lines that stay, and the columns n_lines and n_dropped (they replace such columns of the input).

    A line's key is the line without ASCII white space at its ends and with A-Z folded.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents (distinct
    ids; null is one id) lose all their lines but in the document with the largest id
    (null is smallest; all rows with that id keep theirs).  A text that loses nothing
    stays as it is, null becomes empty.  A row is told apart by its id and its text,
    so repeated rows get the same result; an empty table gives no rows.  Other columns stay,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    lines = saved(rows.mapInArrow(_explode(min_chars), f"l_doc {kind(docs, 'doc_id')}, l_text bigint, key binary, numbers array<int>"))
    held = lines.select("key", "l_doc")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        held = held.distinct()  # a key counts once for an id, also if several rows have it
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("l_doc").alias("keeper"))
    common = saved(counted.filter(F.col("n") >= min_docs).select("key", "keeper"))
    gone = (
        spread_join(lines, common, "key", "inner").filter(~F.col("l_doc").eqNullSafe(F.col("keeper")))
        .groupBy("l_doc", "l_text").agg(F.flatten(F.collect_set("numbers")).alias("gone"))
    )
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("m_doc"), F.xxhash64("text").alias("m_text"))
    both = mine.join(gone, F.col("m_doc").eqNullSafe(F.col("l_doc")) & (F.col("m_text") == F.col("l_text")), "left")
    row = F.col("row")
    text = F.coalesce(row["text"], F.lit(""))
    stay = lambda ls: F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")))  # noqa: E731 - by hash set: a text may have very many lines
    joined = lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n")
    rest = F.transform(F.array(F.split(text, "\n", -1)), joined)[0]  # split once
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(rest).alias("text") if c == "text" else row[c].alias(c) for c in names],
        line_count(row["text"]).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
