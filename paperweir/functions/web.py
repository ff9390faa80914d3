"""Hosts of URLs and the sites they belong to, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_host(url: Column) -> Column:
    """Host of a URL, lower case, without port and one leading www., m. or amp.; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^(?:www|m|amp)\.", ""), F.lit(""))


def source_sites(sources: DataFrame) -> DataFrame:
    """(source_id, has_url, host) of every source, rows repeated in full once.

    A source without canonicalUrl keeps host null. Distinct on three short columns only, so the shuffle does not
    carry the record.
    """
    url = F.col("origin.canonicalUrl")
    return sources.select(F.col("id").alias("source_id"), url.isNotNull().alias("has_url"), site_host(url).alias("host")).where(F.col("source_id").isNotNull()).distinct()
