"""Whole files: fingerprints and listings, without reading them as media."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 * 1024 * 1024


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, modified) of the files below a folder, without their content; ``suffixes`` in lower case, all files without."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if suffixes:
        f = f.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _hash_file(path: str, size: int, modified_us: int) -> str:
    """SHA-256 of a file, read in blocks; raises if it is not what the listing saw, before and after reading."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)

    def check() -> None:
        now = store.get_file_info(at)
        if now.size != size or (now.mtime_ns is not None and abs(now.mtime_ns // 1000 - modified_us) >= 1_000_000):
            raise RuntimeError(f"file changed while it was read: {path}")

    check()
    digest = hashlib.sha256()
    with store.open_input_stream(at) as stream:
        while block := stream.read(BLOCK_BYTES):
            digest.update(block)
    check()
    return digest.hexdigest()


def fingerprints(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, sha256) of the files below a folder, of any size, a block in memory at a time.

    A file that changes between listing and the end of reading fails the job, as its hash would name no content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, size, modified in zip(f["path"], f["size"], f["us"], strict=True):
                yield pd.DataFrame({"path": [path], "size": [size], "sha256": [_hash_file(path, int(size), int(modified))]})

    files = listing(spark, folder, suffixes).select("path", "size", F.unix_micros("modified").alias("us"))
    spread = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(run, "path string, size bigint, sha256 string")


def photos_of(listed: DataFrame, keys: DataFrame, key: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """(key, path): each key's picture, the file whose name without suffix is the key; of several the first path. Keys without one have null."""
    name = F.element_at(F.split("path", "/"), -1)
    f = listed.select("path", F.regexp_extract(name, r"\A(.*)(\.[^.]+)\z", 1).alias(key), F.lower(F.regexp_extract(name, r"(\.[^.]+)\z", 1)).alias("_s")).where(F.col("_s").isin(*suffixes))
    return keys.select(key).distinct().join(f.groupBy(key).agg(F.min("path").alias("path")), key, "left")


def video_metadata(videos: DataFrame) -> DataFrame:
    """Adds ``duration_us``, frames by rate; null where either is missing or not positive."""
    ok = (F.col("fps") > 0) & (F.col("frame_count") > 0)
    return videos.withColumn("duration_us", F.when(ok, F.rint(F.col("frame_count") / F.col("fps") * 1e6).cast("bigint")))
