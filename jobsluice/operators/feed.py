"""Queries over the jobs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.operators.state import shown_at
from jobsluice.settings import DEFAULT, Settings


def is_aggregator(uid: Column) -> Column:
    """Restated by an aggregator rather than posted by the employer."""
    return uid.rlike("(?i)^(?:" + "|".join(vocab.AGGREGATOR_PREFIXES) + ")")


def undated_seed() -> Column:
    """Recorded by a seed without a provider date: its age is unknown."""
    return (F.coalesce("posted_at", F.lit(0)) == 0) & F.col("seeded")


def feed_roles(jobs: DataFrame, tier: str, as_of: int, max_age_hours: int | None,
               cfg: Settings = DEFAULT) -> DataFrame:
    """One row per open role of a tier inside its window: the copy to show.

    A role is closed once its employer's own copy is. The employer's copy is
    shown before an aggregator's, a dated one before an undated, then the
    oldest. One aggregate per role: copies combine before the shuffle, so a
    role with very many copies costs no more than its distinct ones per task.
    """
    rows = jobs.where(F.col("tier") == tier)
    if max_age_hours:
        age = F.when(undated_seed(), F.col("last_seen")).otherwise(shown_at())
        rows = rows.where(age >= as_of - max_age_hours * 3600)
    third_party, gone = is_aggregator(F.col("uid")), F.col("misses") >= cfg.closed_after_misses
    rank = F.struct(third_party, F.coalesce("posted_at", F.lit(0)) <= 0, "first_seen", "uid")
    copy = F.struct(*jobs.columns, shown_at().alias("shown_at"))
    roles = rows.groupBy(F.coalesce("group_id", "fingerprint").alias("grp")).agg(
        F.max(gone & ~third_party).alias("_closed"),
        F.min_by(F.when(~gone, copy), F.when(~gone, rank)).alias("_copy"))
    return roles.where(~F.col("_closed") & F.col("_copy").isNotNull()).select("_copy.*")


def recent_jobs(jobs: DataFrame, tier: str, as_of: int, limit: int = 60,
                max_age_hours: int | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """The newest roles of a tier, those of unknown age last."""
    return feed_roles(jobs, tier, as_of, max_age_hours, cfg).orderBy(
        undated_seed(), F.desc("shown_at"), "uid").limit(limit)


def count_jobs(jobs: DataFrame, tier: str, as_of: int, max_age_hours: int | None = None,
               cfg: Settings = DEFAULT) -> DataFrame:
    return feed_roles(jobs, tier, as_of, max_age_hours, cfg).agg(F.count("*").alias("roles"))


def heading_count(jobs: DataFrame, tier: str, as_of: int, limit: int,
                  max_age_hours: int | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """``60 of 412`` when the list is cut, else just the count."""
    total = F.col("roles").cast("string")
    text = F.when(F.col("roles") > limit, F.concat(F.lit(f"{limit} of "), total)).otherwise(total)
    return count_jobs(jobs, tier, as_of, max_age_hours, cfg).select("roles", text.alias("heading"))


def tier_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("tier", F.lit("rejected")).alias("tier")).agg(
        F.count("*").alias("jobs"))


def reason_counts(jobs: DataFrame, samples: int = 5) -> DataFrame:
    """Count and newest sample titles per (tier, reason).

    Samples come from a limited window: each task keeps only its own newest
    few per reason before the shuffle.
    """
    named = jobs.select(
        F.coalesce("tier", F.lit("rejected")).alias("tier"),
        F.coalesce("reason", F.lit("")).alias("reason"), "first_seen", "uid",
        F.concat("company", F.lit(" — "), "title").alias("sample"))
    counts = named.groupBy("tier", "reason").agg(F.count("*").alias("jobs"))
    newest = Window.partitionBy("tier", "reason").orderBy(F.desc("first_seen"), "uid")
    picked = named.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= samples)
    lists = picked.groupBy("tier", "reason").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))),
                                 lambda s: s["sample"]), "; ").alias("samples"))
    return counts.join(lists, ["tier", "reason"]).orderBy(F.desc("jobs"), "tier", "reason")


def pending_digest(jobs: DataFrame) -> DataFrame:
    """Loose roles waiting for the digest, by company and title."""
    return jobs.where((F.col("tier") == "loose") & ~F.col("digested")).orderBy(
        "company", "title", "uid")
