"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.operators.timestamps import MomentDictionary, located_values, normalise_moments
from paperweir.session import table


def _all(spark: SparkSession, d: str) -> DataFrame:
    located = located_values(table(spark, d, "sources"), table(spark, d, "web_articles"), table(spark, d, "sites"))
    return normalise_moments(located, MomentDictionary(spark))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the two date fields that names a moment or full day, with its UTC milliseconds."""
    return _all(spark, d).where("utc_ms is not null").select("source_id", "field_name", "utc_ms")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Values by field: all, blank, with an instant."""
    return _all(spark, d).groupBy("field_name").agg(
        F.count("*").alias("n_values"), F.count_if(F.trim("raw") == "").alias("n_blank"), F.count("utc_ms").alias("n_instants")
    )


QUERIES = {"p2_found": found, "p2_coverage": coverage}
SQL: dict[str, str] = {}
