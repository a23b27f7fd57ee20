"""Command line: python -m uploadwatch run | preflight | canary.

run        pages and title list to tables, log and statistics; exit code 0, or 1 if a table could not be written
preflight  whether settings allow a run; exit code 0 or 1
canary     the five checks of a run's statistics, as JSON; exit code 0 if healthy, 1 if degraded, 2 if critical
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from uploadwatch import schemas
from uploadwatch.config import Settings
from uploadwatch.operators import health
from uploadwatch.plans import run as batch_run
from uploadwatch.sources import crawl, files, tables


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="uploadwatch", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run")
    one.add_argument("--pages", action="append", required=True, metavar="PLATFORM=PATH", help="Parquet pages (query, html, seq) of a platform; may be repeated")
    one.add_argument("--titles", required=True)
    one.add_argument("--whitelist", required=True)
    one.add_argument("--tables", required=True, help="folder of the detections and registry tables and the run log")
    one.add_argument("--stats", help="folder for the run's statistics as JSON")
    one.add_argument("--no-fuzzy", action="store_true")
    one.add_argument("--dry-run", action="store_true", help="score only; change no table")
    commands.add_parser("preflight")
    check = commands.add_parser("canary")
    check.add_argument("--stats", required=True)
    check.add_argument("--run-id", default="manual")
    return parser.parse_args(given)


def _run(spark: SparkSession, asked: argparse.Namespace) -> int:
    started, folder, errors, failed = _now(), asked.tables.rstrip("/"), [], 0
    pages = {platform: spark.read.schema(schemas.PAGES).parquet(path) for platform, path in (p.split("=", 1) for p in asked.pages)}
    found = crawl.crawl_all(pages, started, platforms=list(pages), errors=errors)
    held = {n: tables.Table(spark, f"{folder}/{n}", s) for n, s in (("detections", schemas.DETECTIONS_TABLE), ("registry", schemas.OFFENDER))}
    settings = Settings(fuzzy_threshold=None) if asked.no_fuzzy else Settings()
    done = batch_run.run(
        found, files.whitelist(spark, asked.whitelist), files.titles(spark, asked.titles), started, held["registry"].read(), held["detections"].read(), settings, platforms=list(pages), dry_run=asked.dry_run, errors=errors
    )
    if not asked.dry_run:
        for name, rows in (("registry", done.registry), ("detections", done.detections)):
            try:
                held[name].write(rows)
            except Exception as e:  # the other table and the log are still written
                failed += 1
                errors.append(f"{name}: {type(e).__name__}")
    stats = done.stats.withColumns({"errors": F.array(*map(F.lit, errors)).cast("array<string>"), "sheet_write_errors": F.lit(failed)})
    if not asked.dry_run:
        tables.Log(spark, f"{folder}/log", schemas.RUN_LOG).append(tables.run_log_row(stats, f"run-{started}", started, _now()))
    if asked.stats:
        files.write_stats(stats, asked.stats)
    print(health.stats_json(stats))
    return int(failed > 0)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = _arguments(given)
    if asked.command == "preflight":
        good, rows = health.preflight(dict(os.environ), os.path.isfile)
        print(json.dumps(rows))
        return int(not good)
    spark = spark or SparkSession.builder.appName("uploadwatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.command == "run":
        return _run(spark, asked)
    found = health.report(files.run_stats(spark, asked.stats), asked.run_id, _now())
    print(json.dumps(found))
    return health.OVERALL.index(found["overall_status"])


if __name__ == "__main__":
    sys.exit(main())
