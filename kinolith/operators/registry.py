"""A content-addressed registry of texts: ids, use counts, statistics, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions.text import before_underscore
from kinolith.operators.assembly import running_total


def register(rows: DataFrame, text: str, position: str, at: Column | None = None) -> DataFrame:
    """id, seq, sha256, len, uses_count, first_position of each distinct non-blank text.

    The id is the digest's first 12 characters; texts that share them get _1, _2, … by first use.
    """
    used = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    one = used.groupBy(F.col(text).alias("seq")).agg(F.count("*").alias("uses_count"), F.min(position).alias("first_position"))
    one = one.withColumn("sha256", F.sha2("seq", 256)).withColumn("_base", F.substring("sha256", 1, 12))
    at_base = F.row_number().over(Window.partitionBy("_base").orderBy("first_position", "sha256")) - 1  # collisions only
    name = F.when(at_base > 0, F.concat_ws("_", "_base", at_base.cast("string"))).otherwise(F.col("_base"))
    return one.select(name.alias("id"), "seq", "sha256", F.length("seq").alias("len"), "uses_count", "first_position")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry after an upsert: use counts add up, the older id stays."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    best = both.groupBy("sha256").agg(
        F.min(F.struct("_age", "id", "seq", "len", "first_position")).alias("one"), F.sum("uses_count").alias("uses_count")
    )
    return best.select("one.id", "one.seq", "sha256", "one.len", "uses_count", "one.first_position")


USAGE = "sha256 string, seq string, uses_count long, first_at timestamp, last_at timestamp"


def usage_of(rows: DataFrame, text: str, at: str) -> DataFrame:
    """USAGE rows: how often each non-blank text is used, and when first and last."""
    used = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").groupBy(F.col(text).alias("seq"))
    counts = used.agg(F.count("*").alias("uses_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return counts.select(F.sha2("seq", 256).alias("sha256"), "seq", "uses_count", "first_at", "last_at")


def from_usage(usage: DataFrame) -> DataFrame:
    """id, seq, sha256, len, uses_count, first_at, last_at of each text from increments of any number of batches and writers.

    Ids are as in register(): they follow first use, so that they stay as more is added.
    """
    one = usage.groupBy("sha256").agg(
        F.min("seq").alias("seq"), F.sum("uses_count").alias("uses_count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    one = one.withColumn("_base", F.substring("sha256", 1, 12))
    at_base = F.row_number().over(Window.partitionBy("_base").orderBy("first_at", "sha256")) - 1  # collisions only
    name = F.when(at_base > 0, F.concat_ws("_", "_base", at_base.cast("string"))).otherwise(F.col("_base"))
    return one.select(name.alias("id"), "seq", "sha256", F.length("seq").alias("len"), "uses_count", "first_at", "last_at")


def totals(registry: DataFrame) -> DataFrame:
    """Rows, uses, never-used rows and their share."""
    one = registry.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("uses_count"), F.lit(0)).alias("uses"), F.count_if(F.col("uses_count") == 0).alias("unused")
    )
    return one.withColumn("unused_share", F.coalesce(F.try_divide("unused", "n"), F.lit(0.0)))


def length_quantiles(registry: DataFrame, length: str, quantiles: Sequence[float]) -> DataFrame:
    """Values at ceil(q * n) of the sorted lengths, from running totals of the counts per length: no sort of all rows."""
    counts = registry.groupBy(F.col(length).alias("v")).agg(F.count("*").alias("k"))
    up = running_total(counts, ["v"], F.col("k"), "upto")
    up = up.crossJoin(F.broadcast(up.agg(F.sum("k").alias("n"))))  # one row
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    return up.select("v", "upto", "n", wanted).where(F.col("upto") >= F.ceil(F.col("q") * F.col("n"))).groupBy("q").agg(F.min("v").alias("value"))


def extremes(registry: DataFrame, length: str, key: str) -> DataFrame:
    """which (shortest, longest), key and length: the first by length and then key; of equal longest ones the smallest key."""
    ends = registry.where(F.col(length).isNotNull()).agg(
        F.min(F.struct(F.col(length).alias("size"), F.col(key).alias("k"))).alias("shortest"),
        F.min(F.struct((-F.col(length)).alias("size"), F.col(key).alias("k"))).alias("longest"),
    )
    pairs = F.array(
        F.struct(F.lit("shortest").alias("which"), F.col("shortest.k").alias(key), F.col("shortest.size").alias(length)),
        F.struct(F.lit("longest").alias("which"), F.col("longest.k").alias(key), (-F.col("longest.size")).alias(length)),
    )
    return ends.where("shortest is not null").select(F.inline(pairs))


def recent_counts(rows: DataFrame, at: str, now: Column, days: Sequence[int]) -> DataFrame:
    """Rows within each number of days before now, in one pass."""
    one = rows.agg(*[F.count_if(F.col(at) >= now - F.expr(f"make_dt_interval({d})")).alias(f"d{d}") for d in days])
    return one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"d{d}").alias("n")) for d in days])))


def prefix_collisions(registry: DataFrame, size: int = 12) -> DataFrame:
    """Digest prefixes held by more than one row, and the rows beyond the first of each."""
    groups = registry.groupBy(F.substring("sha256", 1, size).alias("prefix")).agg(F.count("*").alias("n"))
    return groups.where("n > 1").agg(F.count("*").alias("prefixes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_ids"))


def mismatches(registry: DataFrame) -> DataFrame:
    """Rows whose id does not begin with its digest."""
    return registry.agg(F.count_if(before_underscore(F.col("id")) != F.substring("sha256", 1, 12)).alias("mismatches"))
