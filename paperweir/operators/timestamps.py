"""Mixed timestamp formats and zones brought to one UTC instant.

Distinct (raw value, home zone, date order) triples form a dictionary; each is parsed exhaustively once, the result
is kept as a table that later runs only add to, and the instants are joined back to the rows. Work in Python is per
distinct value; zone arithmetic runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.moments import read_moment
from paperweir.functions.web import source_sites
from paperweir.session import materialise

KEYS = ["raw", "zone", "date_order"]
_READ = "raw string, zone string, date_order string, ms long, named_zone string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [read_moment(r, o) for r, o in zip(pdf["raw"], pdf["date_order"], strict=True)]
        pdf["ms"] = pd.array([None if x is None else x[0] for x in found], dtype="Int64")
        pdf["named_zone"] = [None if x is None else x[1] for x in found]
        yield pdf


def parse_distinct(values: DataFrame) -> DataFrame:
    """values(raw, zone, date_order) -> the same with utc_ms, one row a distinct triple.

    utc_ms is null where the value names no full calendar day. A repeated local time is the earlier one, a skipped
    one moves forward by the gap (java.time's rule, which to_utc_timestamp follows). A zone name that does not exist
    gives null.
    """
    spark = values.sparkSession
    zones = _zone_names(spark)
    read = values.select(*KEYS).where("raw is not null").distinct().mapInPandas(_read, _READ)
    place = F.when(F.col("named_zone") == "", F.coalesce("zone", F.lit("UTC"))).otherwise(F.col("named_zone"))
    usable = F.when(F.array_contains(zones, place), place)
    local = F.timestamp_millis("ms")
    utc = F.when(F.col("named_zone").isNull(), F.col("ms")).otherwise(F.unix_millis(F.to_utc_timestamp(local, usable)))
    return read.select(*KEYS, utc.alias("utc_ms"))


def _zone_names(spark: SparkSession):
    import zoneinfo

    return F.array(*[F.lit(z) for z in sorted(zoneinfo.available_timezones()) if "/" in z or z in ("UTC", "GMT")])


class MomentDictionary:
    """The persisted dictionary: a table (raw, zone, date_order, utc_ms) in a shared folder.

    update() parses only triples that the table lacks and appends them, so a corpus that grows pays for new spellings
    alone. Without a path the dictionary is a working table of this session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def update(self, values: DataFrame) -> DataFrame:
        if self.path is None:
            return materialise(parse_distinct(values), "moments")
        if self._exists():
            old = self.spark.read.parquet(self.path)
            on = [values[k].eqNullSafe(old[k]) for k in KEYS]
            values = values.join(old, on[0] & on[1] & on[2], "left_anti")
        parse_distinct(values).write.mode("append").option("compression", "zstd").parquet(self.path)
        # two runs at once may both have added a value; they read it alike
        return self.spark.read.parquet(self.path).dropDuplicates(KEYS)


def located_values(sources: DataFrame, web_articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(source_id, field_name, raw, zone, date_order) of both date fields; repeated rows of sources once.

    zone and date_order come from the site of the source's canonicalUrl; without one the value counts as UTC.
    """
    places = source_sites(sources).join(sites.select("host", F.col("home_zone").alias("zone"), "date_order"), "host", "left").select("source_id", "zone", "date_order")
    published = sources.select(F.col("id").alias("source_id"), F.lit("publishedAt").alias("field_name"), F.col("publishedAt").alias("raw"))
    dated = web_articles.select(F.col("sourceId").alias("source_id"), F.lit("date").alias("field_name"), F.col("date").alias("raw"))
    return published.unionByName(dated).where("raw is not null and source_id is not null").distinct().join(places, "source_id", "left")


def normalise_moments(located: DataFrame, dictionary: MomentDictionary) -> DataFrame:
    """located(…, raw, zone, date_order) -> the same rows with utc_ms, null where the value names no moment.

    Nulls and blanks in raw stay rows with a null instant. Ties and repeated rows keep their number. Two values differ
    where raw, zone or order differ, nulls being equal.
    """
    blank = F.coalesce(F.trim("raw") == "", F.lit(True))
    known = dictionary.update(located.where(~blank).select(*KEYS))
    same = [F.coalesce(F.col(k), F.lit("")) for k in ("zone", "date_order")]
    rows = located.drop("utc_ms")
    left = rows.where(~blank).withColumns({"_z": same[0], "_o": same[1]})
    right = known.select("raw", same[0].alias("_z"), same[1].alias("_o"), "utc_ms")
    read = left.join(right, ["raw", "_z", "_o"], "left").select(*rows.columns, "utc_ms")
    # blank values, of which there may be very many, are not sent through the join
    return read.unionByName(rows.where(blank).withColumn("utc_ms", F.lit(None).cast("long")))
