"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  Columns that documents have besides are passed on, whatever
their names, but by the last stage.  An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import ensure_checkpoint_dir
from fleetlens.llm.decontam import drop_contaminated
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.mixing import mix
from fleetlens.llm.quality import keep_good
from fleetlens.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps.

    A text without words (null, empty) weighs 1, neither for nor against it.  Rows equal in
    id and text get the same draw and stay or go together, as do others whose keys tie.
    Without labels of both classes all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share but for the copy of the largest id; n_chars follows the text.

    A null text becomes an empty one, an empty one stays; repeated rows lose the same lines;
    null ids count as one document, the smallest.
    """
    held = {c: f"the documents' {c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # columns that the operator would replace
    out = dedup_lines(docs.withColumnsRenamed(held)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8).

    Of a group the smallest id stays, null ids last, and of its rows one.  Texts without words
    (null, empty) are alike, so one of them stays; texts of fewer than five words are one shingle.
    """
    return keep_one(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows stay or go together; ids play no part.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and the words that makes: doc_id, source, size, source_size, target, copies and taken.

    Null and empty texts have no words, so what is taken of them is 0; a null source is one of
    its own, the last; repeated rows are drawn one by one, and which of them falls is left open.
    """
    return mix(docs).withColumn("taken", F.col("size") * F.col("copies"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: The draws of the first and last stage and the fingerprints of the third are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result stored as Parquet in the shared checkpoint folder.

    A stage's result goes once the next one is stored; the last one that is stored stays, as
    the returned rows are read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
