"""Archives of JSON documents: a tar.gz of one folder an entity, and folders that Spark reads and writes.

A tar.gz is one stream, so reading it is one task's work; it is for moving an
inventory, and what is unpacked is JSON lines that Spark reads in parallel.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anonymize import anonymize
from .store import SCHEMAS, Store


def write_folder(store: Store, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> None:
    """JSON lines, one folder a relation."""
    for name in names:
        df = store[name]
        df = df.withColumns({c: F.to_json(F.map_from_arrays(F.map_keys(c), F.map_values(c))) for c, kind in df.dtypes if kind == "map<string,variant>"})
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def read_folder(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> Store:
    def reader(name: str):
        def read() -> DataFrame:
            flat = SCHEMAS[name].replace("map<string,variant>", "string")
            df = spark.read.schema(flat).json(f"{folder}/{name}")
            maps = [f.split()[0] for f in SCHEMAS[name].split(", ") if f.endswith("map<string,variant>")]
            return df.withColumns({c: F.from_json(c, "map<string,variant>") for c in maps})

        return read

    return Store(spark, {name: reader(name) for name in names})


def pack(path: str, documents: Iterator[tuple[str, dict]]) -> None:
    """Documents by name, as ``entity/name.json``, into a tar.gz."""
    with tarfile.open(path, "w:gz") as tar:
        for name, document in documents:
            body = json.dumps(document, sort_keys=True).encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def unpack(path: str) -> Iterator[tuple[str, dict]]:
    with tarfile.open(path, "r:gz") as tar:
        for info in tar:
            if info.isfile() and info.name.endswith(".json") and (body := tar.extractfile(info)):
                yield info.name, json.load(body)


def export(store: Store, path: str, names: tuple[str, ...] = ("factsets", "catalogs", "reports"), profile: str = "none", salt: str = "") -> None:
    """The relations' rows into a tar.gz, streamed through the driver a partition at a time, masked as the profile says."""

    def documents() -> Iterator[tuple[str, dict]]:
        for name in names:
            for i, row in enumerate(anonymize(store[name], profile, salt).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
                yield f"{name}/{i:09d}.json", json.loads(row["j"])

    pack(path, documents())


def time_shift(df: DataFrame, to: str, columns: list[str] | None = None) -> DataFrame:
    """Every timestamp moved by what brings the newest of them to ``to``."""
    stamps = columns or [c for c, kind in df.dtypes if kind == "timestamp"]
    newest = df.agg(F.max(F.greatest(*stamps) if len(stamps) > 1 else F.col(stamps[0])).alias("t")).first()["t"]
    if newest is None:
        return df
    shift = F.unix_micros(F.lit(to).cast("timestamp")) - F.unix_micros(F.lit(newest))
    return df.withColumns({c: F.timestamp_micros(F.unix_micros(c) + shift) for c in stamps})
