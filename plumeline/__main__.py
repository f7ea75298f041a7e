"""python -m plumeline --landed DIR --table PATH [--source NAME] [--max-retries N] [--runs PATH] [--due]: one line for each source, exit code 1 if one failed.

Landed payloads are files in DIR/<source>; their observations are inserted into the table where they are new. Without --source the sources that
have a folder are collected, with --due those of them whose turn has come. Each run is a row of the run log (by default PATH-runs).
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import runs, store
from .session import session
from .sources import registry


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def work(spark: SparkSession, source: str, landed: str, table: str):
    def collect() -> int:
        rows = spark.read.text(f"{landed}/{source}", wholetext=True).select(F.col("value").alias("payload"), F.lit(source).alias("dataset"))
        found = registry.normalizer(source)(rows).persist()
        try:
            n = found.count()
            store.insert_ignore(table, found, ["raw_json", "value"])
        finally:
            found.unpersist()
        return n

    return collect


def main(arguments: list[str], spark: SparkSession | None = None, sleep=None, now: datetime | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumeline")
    parser.add_argument("--landed", required=True)
    parser.add_argument("--table", required=True)
    parser.add_argument("--source", action="append", choices=registry.names())
    parser.add_argument("--max-retries", type=int, default=3)
    parser.add_argument("--runs")
    parser.add_argument("--due", action="store_true")
    given = parser.parse_args(arguments)
    spark = spark or session()
    log, now = given.runs or f"{given.table.rstrip('/')}-runs", now or datetime.now(UTC)
    names = given.source or [n for n in registry.names() if exists(spark, f"{given.landed}/{n}")]
    if given.due and exists(spark, log):
        turn = {r.source for r in runs.due(spark.read.parquet(log), now, {n: S.COLLECT_MINUTES.get(n, 60) for n in names}, {n: h for n, h in S.COLLECT_DAILY.items() if n in names}).collect()}
        names = [n for n in names if n in turn]
    results = runs.run_all({name: work(spark, name, given.landed, given.table) for name in names}, max_retries=given.max_retries, **({"sleep": sleep} if sleep else {}))
    if not results:
        return 0
    done = runs.logged(spark, log, results, now)
    for row in runs.report(done).orderBy("seq").collect():
        print(row.line)
    return runs.exit_code(done).first().exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
