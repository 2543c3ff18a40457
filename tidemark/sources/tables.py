"""Readers of the input tables and of delimited receipt and staff files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT_FILE_COLUMNS = ("TT", "OrderId", "openTime", "dl_tm", "OrderSum", "stol_num", "Client_TTGID")
STAFF_FILE_COLUMNS = ("id_staff", "position", "first_name", "last_name", "gender", "age")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """Headed CSV read as text columns only; header names are trimmed.

    Raises ``ValueError`` for another suffix than ``.csv`` and for a missing column. Cells keep
    their text: typing is a later projection, so that a bad cell becomes a reject row, not a failed job.
    """
    if os.path.splitext(path.rstrip("/"))[1].lower() != ".csv":
        raise ValueError(f"unsupported file type: {path}")
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    df = df.toDF(*[c.strip() for c in df.columns])
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df


def read_receipts_csv(spark: SparkSession, path: str) -> DataFrame:
    """The seven receipt columns as text, with the file's name in ``source_file``."""
    df = read_delimited(spark, path, RECEIPT_FILE_COLUMNS)
    return df.select(*RECEIPT_FILE_COLUMNS).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_staff_csv(spark: SparkSession, path: str) -> DataFrame:
    """Staff registry text columns; null or repeated ``id_staff`` and an empty file raise ``ValueError``."""
    df = read_delimited(spark, path, STAFF_FILE_COLUMNS).select(*STAFF_FILE_COLUMNS)
    bad = df.groupBy("id_staff").count().where("count > 1 or id_staff is null").limit(20).collect()
    if bad:
        raise ValueError(f"{path}: null or repeated id_staff {[r.id_staff for r in bad]}")
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Rewrites only the partitions of ``by`` that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Rewrites the partitions of ``by`` that ``df`` holds and deletes those it does not."""
    write_partitioned(df, path, by)
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    keep = {"__HIVE_DEFAULT_PARTITION__" if r[0] is None else str(r[0]) for r in df.select(by).distinct().toLocalIterator()}
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith(f"{by}=") and name[len(by) + 1 :] not in keep:
            fs.delete(folder.getPath(), True)
