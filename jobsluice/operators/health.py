"""How the sources are doing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsluice.settings import DEFAULT, Settings


def health_table(health: DataFrame) -> DataFrame:
    """State per source, failing first: FAIL, empty (answers but never listed), ok."""
    state = F.when(~F.col("ok"), "FAIL").when(
        F.coalesce("job_count", F.lit(0)) == 0, "empty").otherwise("ok")
    error = F.when(~F.col("ok"), F.substring(F.coalesce("last_error", F.lit("")), 1, 90)
                   ).otherwise("")
    return health.select("source", "job_count", state.alias("state"), error.alias("error"),
                         "ok").orderBy("ok", "source").drop("ok")


def health_alert(errors: DataFrame, total_sources: int, cfg: Settings = DEFAULT) -> DataFrame:
    """One warning row when too large a share of sources failed, else none.

    ``errors(source, seq)``; the first four are named, taken by a top-k and
    not by gathering the list.
    """
    worst = errors.orderBy("seq").limit(4).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda e: e["source"]), ", ")
        .alias("worst"))
    counted = errors.agg(F.count("*").alias("failing"))
    one = F.lit(1).alias("_one")
    both = counted.select("*", one).join(worst.select("*", one), "_one")
    ratio = F.col("failing") / F.lit(max(total_sources, 1))
    text = F.concat(
        F.col("failing").cast("string"), F.lit(f"/{total_sources} sources failing ("),
        F.format_string("%.0f%%", ratio * 100), F.lit("): "), F.col("worst"))
    return both.where((ratio > cfg.health_fail_threshold) & F.lit(total_sources > 0)).select(
        "failing", text.alias("message"))


def source_count(sources: DataFrame) -> DataFrame:
    """Configured sources: boards, trackers and portfolio boards."""
    return sources.groupBy("kind").agg(F.count("*").alias("sources"))
