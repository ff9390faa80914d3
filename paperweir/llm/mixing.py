"""Mixing of sources to target weights.

Each document gets a hash key; within its source documents stand in the order of the key, and the tokens before each
one are a distributed prefix sum on three levels: sums by (source, bucket of the key), by (source, part of the buckets)
and by source, each level adding what stands before it, so no task orders more than a few thousand rows. A source's budget is cut at the exact place of that order; where the budget exceeds the source, it
is repeated whole, up to its cap, and the last epoch is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweir.session import materialise

#: Documents that a bucket holds about, and buckets that a part holds.
BUCKET_DOCUMENTS, PART_BUCKETS = 2_000, 2_000


def ordered_tokens(sized: DataFrame, seed: int = 0) -> DataFrame:
    """sized(doc_id, source, n_tokens) -> the same with before, the tokens of its source that stand before the document.

    The order is that of a hash of the id, ties by the id. A hot source is spread over its buckets.
    """
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    counts = sized.groupBy("source").agg(F.count("*").alias("n_source"))
    keyed = sized.join(counts, "source").withColumn("key", key)
    # the bucket is the key's place among equal parts of its range, so buckets are in the order of the key
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_source") / BUCKET_DOCUMENTS)).cast("long")
    keyed = keyed.withColumn("bucket", F.floor((F.col("key").cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    before = lambda value, *keys: Window.partitionBy(*keys).orderBy(*value).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s")).withColumn("part", F.floor(F.col("bucket") / PART_BUCKETS))
    parts = sums.groupBy("source", "part").agg(F.sum("s").alias("s")).select("source", "part", F.coalesce(F.sum("s").over(before(["part"], "source")), F.lit(0)).alias("outer"))
    within = sums.withColumn("start", F.coalesce(F.sum("s").over(before(["bucket"], "source", "part")), F.lit(0)))
    starts = within.join(parts, ["source", "part"]).select("source", "bucket", (F.col("outer") + F.col("start")).alias("start"))
    inside = before(["key", "doc_id"], "source", "bucket")
    placed = keyed.join(starts, ["source", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.select("doc_id", "source", "n_tokens", "before")


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """targets(source, target_share, max_repeats) -> with available, budget, repeats needed, in tokens.

    Without total the mixture is the largest in which every source keeps its share within its cap. With a total, a
    source that cannot reach its share gives all it may, and its actual share falls short. Sources without documents
    have a budget of 0 and don't hold the others back.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).where("source is not null and target_share > 0")
    sides = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("available") * F.col("max_repeats")
    if total is None:
        # a few rows, one a target: the scalar may come to the driver
        largest = sides.where("available > 0").select(F.min(most / F.col("target_share"))).first()[0]
        total = int(largest or 0)
    wanted = F.floor(F.lit(total) * F.col("target_share")).cast("long")
    return sides.withColumn("budget", F.least(wanted, most.cast("long"))).withColumn("epochs", F.when(F.col("available") > 0, F.ceil(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, taken) of the mixture: each document once an epoch, taken tokens of it.

    All documents are whole but the one at which a source's budget ends: of it only taken tokens count. Documents
    without tokens and of sources without target are left out. Null ids and sources take no part.
    """
    usable = sized.select("doc_id", "source", "n_tokens").where("doc_id is not null and source is not null and n_tokens > 0").dropDuplicates(["doc_id"])
    usable = materialise(usable, "usable")
    # one row a target
    plan = materialise(budgets(usable, targets, total).where("budget > 0").select("source", "available", "budget", "epochs"), "plan")
    placed = ordered_tokens(usable.join(plan.select("source"), "source", "left_semi"), seed).join(plan, "source")
    spread = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    at = (F.col("epoch") - 1) * F.col("available") + F.col("before")
    return spread.where(at < F.col("budget")).select("doc_id", "source", "epoch", "n_tokens", F.least(F.col("n_tokens"), F.col("budget") - at).alias("taken"))


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, epochs), one row a target, also for sources that gave nothing."""
    got = mixture.groupBy("source").agg(F.sum("taken").alias("tokens"), F.count("*").alias("documents"), F.max("epoch").alias("epochs"))
    rows = targets.select("source", "target_share").dropDuplicates(["source"]).join(got, "source", "left")
    # the targets are a table of a few rows, so one window over them is bounded
    share = F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return rows.select("source", "target_share", share.alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("epochs", F.lit(0)).alias("epochs"))
