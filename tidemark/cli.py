"""Commands over a folder of Parquet tables: ``python -m tidemark.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import __version__
from tidemark.functions import text as X
from tidemark.operators import matching as M
from tidemark.operators import records as R
from tidemark.operators import sessions as S
from tidemark.params import Params, load
from tidemark.plans import matching as plans
from tidemark.plans import reports
from tidemark.sources import files, tables


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def import_receipts(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    """Appends the file's new receipts to ``out``; those whose amount or id cannot be read go to ``out`` + ``_rejects``."""
    raw = tables.read_receipts_csv(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    typed = raw.select(
        F.col("OrderId").alias("external_receipt_id"), F.col("TT").alias("tt"), F.col("openTime").try_cast("timestamp_ntz").alias("opened_at"), F.col("dl_tm").try_cast("timestamp_ntz").alias("closed_at"),
        X.amount(F.col("OrderSum")).alias("amount"), F.regexp_replace("stol_num", r"\.0$", "").try_cast("int").alias("table_number"), F.col("Client_TTGID").alias("client_external_id"), "source_file",
        F.to_json(F.struct(*tables.RECEIPT_FILE_COLUMNS)).alias("raw_data"), "row_no", (F.col("OrderSum").isNotNull() & X.amount(F.col("OrderSum")).isNull()).alias("bad"),
    )
    good = ~F.col("bad") & F.col("external_receipt_id").isNotNull() & F.col("opened_at").isNotNull() & F.col("closed_at").isNotNull()
    have = spark.read.parquet(out).select("external_receipt_id") if _exists(spark, out) else typed.select("external_receipt_id").limit(0)
    fresh = M.insert_new(have, typed.where(good), "external_receipt_id", [F.col("row_no")]).drop("row_no", "bad").persist()
    rejects = typed.where(~good).drop("row_no", "bad")
    counts = {"rows": raw.count(), "imported": fresh.count(), "rejected": rejects.count()}
    fresh.write.mode("append").parquet(out)
    rejects.write.mode("append").parquet(f"{out}_rejects")
    fresh.unpersist()
    return counts


def register_staff(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    """Brings a registry file into ``out``: new keys are added, known ones replaced."""
    incoming = R.clean_staff(tables.read_staff_csv(spark, path).withColumnRenamed("position", "job_position"))
    old = spark.read.parquet(out) if _exists(spark, out) else incoming.limit(0)
    merged = R.upsert(old.select(*incoming.columns), incoming, "staff_key")
    merged.write.mode("overwrite").parquet(f"{out}.new")
    counts = {"registered": incoming.count(), "stored": spark.read.parquet(f"{out}.new").count()}
    spark.read.parquet(f"{out}.new").write.mode("overwrite").parquet(out)
    return counts


def sync_sessions(spark: SparkSession, sf_dir: str, out: str, params: Params, dry_run: bool) -> dict[str, int]:
    """Recomputes the sessions of all visits, rewrites the recordings that hold any and deletes those that hold none any more; with ``dry_run`` only counts the changes."""
    wanted = S.merge_visits(tables.read_table(spark, sf_dir, "visits"), int(params.sessions.merge_gap_s * 1_000_000))
    compare = [c for c in wanted.columns if c != "session_key"]
    # the schema is named, as a store whose recordings are all gone holds no file to read it from
    stored = spark.read.schema(wanted.schema).parquet(out).select(*wanted.columns) if _exists(spark, out) else wanted.limit(0)
    counts = R.status_counts(M.sync_diff(stored, wanted, "session_key", compare)).first().asDict()
    if not dry_run:
        tables.replace_partitioned(wanted, out, "video_id")
    return counts


def match_receipts(spark: SparkSession, sf_dir: str, out: str) -> dict[str, int]:
    """Writes each session's receipt to ``out`` and counts what changed; sessions without both bounds are not visited, so their stored match survives."""
    wanted = plans.till_matches(spark, sf_dir)
    if _exists(spark, out):
        stored = spark.read.parquet(out).select(*wanted.columns)
        open_ = tables.read_table(spark, sf_dir, "visit_sessions").where("entered_at is null or left_at is null").select(F.col("id").alias("visit_session_id")).distinct()
        wanted = wanted.unionByName(stored.join(open_, "visit_session_id", "left_semi").join(wanted.select("visit_session_id"), "visit_session_id", "left_anti").select(*wanted.columns))
    else:
        stored = wanted.limit(0)
    # the files read are replaced, so rows go to a folder beside them first
    wanted.write.mode("overwrite").parquet(f"{out}.new")
    wanted = spark.read.parquet(f"{out}.new")
    counts = R.status_counts(M.sync_diff(stored, wanted, "visit_session_id", ["receipt_id", "distance_us", "is_ambiguous", "is_group_match"])).first().asDict()
    wanted.write.mode("overwrite").parquet(out)
    return counts


def export_report(spark: SparkSession, sf_dir: str, out: str) -> dict[str, int]:
    """Each report view as Parquet, and as one headed CSV folder, below ``out``."""
    counts = {}
    for name, view in reports.QUERIES.items():
        df: DataFrame = view(spark, sf_dir)
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        done = spark.read.parquet(f"{out}/{name}.parquet")
        done.write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
        counts[name] = done.count()
    return counts


def register_videos(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Adds the files of a folder that ``out`` does not know by their content."""
    f = files.fingerprints(spark, folder).persist()
    have = spark.read.parquet(out).select("sha256") if _exists(spark, out) else f.select("sha256").limit(0)
    fresh = M.insert_new(have, f, "sha256", [F.col("path")]).persist()
    counts = {"files": f.count(), "registered": fresh.count()}
    fresh.write.mode("append").parquet(out)
    return counts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config", help="file of parameters, JSON or YAML")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("config-check")
    for name, args in (("import-receipts", ("path", "out")), ("register-staff", ("path", "out")), ("register-videos", ("folder", "out")), ("match-receipts", ("tables", "out")), ("export-report", ("tables", "out"))):
        c = sub.add_parser(name)
        for x in args:
            c.add_argument(x)
    c = sub.add_parser("sync-visit-sessions")
    c.add_argument("tables")
    c.add_argument("out")
    c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    params = load(a.config) if a.config else Params()
    if a.command == "version":
        out = {"version": __version__}
    elif a.command == "config-check":
        out = params.snapshot() | {"digest": params.digest()}
    else:
        spark = spark or SparkSession.builder.getOrCreate()
        out = {
            "import-receipts": lambda: import_receipts(spark, a.path, a.out),
            "register-staff": lambda: register_staff(spark, a.path, a.out),
            "register-videos": lambda: register_videos(spark, a.folder, a.out),
            "sync-visit-sessions": lambda: sync_sessions(spark, a.tables, a.out, params, a.dry_run),
            "match-receipts": lambda: match_receipts(spark, a.tables, a.out),
            "export-report": lambda: export_report(spark, a.tables, a.out),
        }[a.command]()
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
