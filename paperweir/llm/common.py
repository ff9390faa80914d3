"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.functions.web import site_host


def sites_of_sources(sources: DataFrame) -> DataFrame:
    """(source_id, host): the host of each source's canonicalUrl, repeated rows once; sources without one are left out."""
    return (
        sources.where("id is not null")
        .select(F.col("id").alias("source_id"), site_host(F.col("origin.canonicalUrl")).alias("host"))
        .where("host is not null")
        .distinct()
    )
