"""Commands over a library: python -m paperweir ROOT COMMAND, run by spark-submit or on its own."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperweir.api import Library
from paperweir.operators.library import list_line
from paperweir.session import ship


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperweir", description=__doc__)
    p.add_argument("root", help="folder of the library, on any file system")
    p.add_argument("--now", help="time that new records carry (ISO, UTC); the present by default")
    c = p.add_subparsers(dest="command", required=True)
    read = c.add_parser("read", help="capture a table (Parquet or JSON lines: kind, value, label)")
    read.add_argument("inputs")
    listing = c.add_parser("list", help="the newest articles")
    listing.add_argument("--limit", type=int, default=20)
    c.add_parser("show", help="a record as JSON").add_argument("id")
    render = c.add_parser("render", help="artifacts of all articles as a table (id, artifact)")
    render.add_argument("format", choices=("markdown", "html", "epub"))
    render.add_argument("output")
    c.add_parser("publish", help="artifacts of all articles with their export records, kept in the library").add_argument("format", choices=("markdown", "html", "epub"))
    c.add_parser("verify", help="stored texts that their records don't describe; exit code 1 where there are any")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("paperweir").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    now = a.now or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    lib = Library(spark, a.root, now)
    if a.command == "read":
        inputs = spark.read.parquet(a.inputs) if a.inputs.rstrip("/").endswith(".parquet") else spark.read.schema("kind string, value string, label string").json(a.inputs)
        saved, rejected = lib.ingest(inputs)
        print(f"{saved.count()} saved")
        for r in rejected.groupBy("rejected").count().orderBy(F.desc("count"), "rejected").limit(20).collect():
            print(f"{r['count']} rejected: {r.rejected}")
    elif a.command == "list":
        for r in list_line(lib.list(a.limit)).collect():
            print(r.line)
    elif a.command == "show":
        for text in lib.show(a.id).toJSON().take(1):
            print(text)
    elif a.command == "render":
        lib.export(a.format).where("artifact is not null").write.option("compression", "zstd").parquet(a.output)
    elif a.command == "publish":
        print(f"{lib.publish(a.format).count()} published")
    elif a.command == "verify":
        faults = lib.verify()
        n = faults.count()
        for r in faults.orderBy("id").limit(20).collect():
            print(f"{r.id}: {r.reason}")
        print(f"{n} faults")
        return int(n > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
