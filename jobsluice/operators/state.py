"""State tables and the updates a run makes to them.

Each function takes snapshots and returns the next snapshot; nothing is
changed in place. Times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobsluice.functions.classify import (
    CYCLE_REASONS, NO_AI, NO_PLACE, classify, tier_rank)
from jobsluice.functions.clean import cycle_blob
from jobsluice.functions.cycles import term_label, title_cycles
from jobsluice.functions.describe import description_terms, plain_description, rules_version
from jobsluice.functions.identity import fingerprint
from jobsluice.functions.places import names_a_place
from jobsluice.operators.skew import dimension_lookup, last_by
from jobsluice.settings import DEFAULT, Settings

JOBS_SCHEMA = (
    "uid string, fingerprint string, company string, title string, location string, url string, "
    "source string, tier string, reason string, first_seen bigint, posted_at bigint, "
    "seeded boolean, notified boolean, digested boolean, group_id string, last_seen bigint, "
    "misses int, term string, ai_terms string"
)
JOBS_COLUMNS = [part.split()[0] for part in JOBS_SCHEMA.split(", ")]
ROLE_KEYS_SCHEMA = "key string, group_id string, since bigint"
DESCRIPTIONS_SCHEMA = "uid string, checked_at bigint, score int, terms string, error string"
HEALTH_SCHEMA = ("source string, last_success bigint, last_error string, last_error_at bigint, "
                 "job_count bigint, ok boolean")
DISCOVERED_SCHEMA = (
    "platform string, token string, name string, first_seen bigint, last_canada bigint, "
    "last_ok bigint, last_error string, fails int, canada_hits bigint, job_count bigint, "
    "last_attempt bigint, student_jobs bigint, strict_jobs bigint, ok_streak int"
)
HOSTS_SCHEMA = ("host string, sample_url string, name string, hits bigint, last_seen bigint, "
                "last_sniffed bigint, result string")
CANDIDATES_SCHEMA = (
    "platform string, token string, name string, links bigint, first_seen bigint, "
    "last_seen bigint, checked_at bigint, canada bigint, student bigint, result string"
)
PAYLOADS_SCHEMA = "source string, body_sha2 string, at bigint"
# Posting pages of sitemaps by link and lastmod, with the postings found on each.
PAGES_SCHEMA = (
    "url string, lastmod string, fetched_at bigint, found array<struct<pos:int,title:string,"
    "location:string,link:string,posted_at:bigint>>"
)
# The rules that stored verdicts were made under: one row a kind.
RULES_SCHEMA = "name string, version string"
# The boards to read beside the configured ones, best first.
PROMOTED_SCHEMA = "turn int, name string, platform string, token string"
# Short links resolved for good; an empty target leads nowhere.
LINKS_SCHEMA = "url string, target string"
STATE_SCHEMAS = {
    "jobs": JOBS_SCHEMA, "role_keys": ROLE_KEYS_SCHEMA, "descriptions": DESCRIPTIONS_SCHEMA,
    "health": HEALTH_SCHEMA, "discovered": DISCOVERED_SCHEMA, "hosts": HOSTS_SCHEMA,
    "candidates": CANDIDATES_SCHEMA, "payload_seen": PAYLOADS_SCHEMA,
    "pages": PAGES_SCHEMA, "rules": RULES_SCHEMA, "promoted": PROMOTED_SCHEMA,
    "links": LINKS_SCHEMA,
}
BOARD = ["platform", "token"]
# How snapshots are cut into parts. A run changes the jobs of the sources it met; what
# is added to the other tables is of its own week.
SOURCE_PARTS, WEEK = 64, 7 * 86400
WEEKLY = {"role_keys": "since", "descriptions": "checked_at", "pages": "fetched_at"}


def part_of(table: str) -> Column:
    """The part of a stored table that a row belongs to; small tables are one part."""
    if table == "jobs":
        return F.pmod(F.xxhash64("source"), F.lit(SOURCE_PARTS)).cast("bigint")
    if table in WEEKLY:
        return F.coalesce(F.floor(F.col(WEEKLY[table]) / WEEK), F.lit(-1)).cast("bigint")
    return F.lit(0).cast("bigint")


def columns_of(table: str) -> list[str]:
    return StructType.fromDDL(STATE_SCHEMAS[table]).fieldNames()


def shown_at() -> Column:
    """When a row counts as published: the provider's date, else when it was found."""
    return F.coalesce(F.nullif("posted_at", F.lit(0)), F.col("first_seen"))


def _now(as_of: int) -> Column:
    return F.lit(as_of).cast("bigint")


# --- jobs --------------------------------------------------------------------------


def job_rows(triaged: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Triaged postings in the shape of the jobs table.

    Needs the posting columns, ``verdict``, ``group_id`` and the flags
    ``notified``, ``digested`` and ``seeded``; ``_fingerprint`` is taken where it is known.
    """
    known = "_fingerprint" in triaged.columns
    terms = title_cycles(F.col("title"), cycle_blob(
        F.col("cycle_extra"), F.col("employment_type")), as_of, cfg)
    return triaged.withColumns({
        "fingerprint": F.col("_fingerprint") if known else fingerprint(
            F.col("company"), F.col("title")),
        "tier": F.col("verdict.tier"),
        "reason": F.col("verdict.reason"),
        "first_seen": _now(as_of),
        "last_seen": _now(as_of),
        "misses": F.lit(0),
        "term": term_label(terms, cfg),
        "ai_terms": F.array_join("verdict.ai_terms", ", "),
    }).select(*JOBS_COLUMNS)


def record_postings(jobs: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Insert rows whose uid is not stored yet; stored rows stay as they are."""
    return jobs.unionByName(new_rows.join(jobs.select("uid"), "uid", "left_anti"))


def seed(jobs: DataFrame, triaged: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Record everything as already handled, so that nothing is ever alerted on."""
    flags = {f: F.lit(True) for f in ("seeded", "notified", "digested")}
    return record_postings(jobs, job_rows(triaged.withColumns(flags), as_of, cfg))


def _flag(jobs: DataFrame, uids: DataFrame, flag: str) -> DataFrame:
    marked = uids.select("uid").distinct().withColumn("_hit", F.lit(True))
    return jobs.join(marked, "uid", "left").withColumn(
        flag, F.coalesce("_hit", flag)).select(*jobs.columns)


def mark_notified(jobs: DataFrame, uids: DataFrame) -> DataFrame:
    return _flag(jobs, uids, "notified")


def mark_digested(jobs: DataFrame, uids: DataFrame) -> DataFrame:
    return _flag(jobs, uids, "digested")


def mark_present(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Update presence from complete listings ``(source, uid, stamp, complete)``.

    A listed row is reset. A row its own source listed without, at a time
    after it was last seen, has missed once per such listing. Any number of
    listings may be given at once; the result is as if taken in order.
    """
    whole = listing.where("complete")
    listed = whole.groupBy("uid").agg(F.max("stamp").alias("_listed"))
    # The stamps of one source's runs in this batch: a handful of numbers.
    runs = whole.groupBy("source").agg(F.collect_set("stamp").alias("_runs"))
    joined = dimension_lookup(jobs.join(listed, "uid", "left"), runs, ["source"], ["uid"])
    last = F.greatest("last_seen", F.coalesce("_listed", "last_seen"))
    base = F.when(F.col("_listed").isNotNull(), 0).otherwise(F.col("misses"))
    since = joined.withColumn("_last", last)
    missed = F.coalesce(F.size(F.filter("_runs", lambda s: s > F.col("_last"))), F.lit(0))
    return since.withColumns({
        "misses": (base + F.when(F.col("_runs").isNull(), 0).otherwise(missed)).cast("int"),
        "last_seen": F.when(F.col("_listed").isNotNull(), F.col("_last")).otherwise(
            F.col("last_seen")),
    }).select(*jobs.columns)


def demote_for_cycle(jobs: DataFrame, seen: DataFrame, as_of: int, cfg: Settings = DEFAULT
                     ) -> DataFrame:
    """Lower stored rows whose fresh posting is now out of cycle; nothing else moves."""
    live = jobs.where(F.col("tier").isin("strict", "loose")).select("uid")
    fresh = classify(seen.join(live, "uid", "left_semi"), as_of, cfg).select(
        "uid", F.col("verdict").alias("_v")).where(F.col("_v.reason").isin(CYCLE_REASONS))
    joined = jobs.join(fresh, "uid", "left")
    lower = F.coalesce(tier_rank(F.col("_v.tier")) < tier_rank(F.col("tier")), F.lit(False)) \
        & F.col("_v").isNotNull()
    return joined.withColumns({
        "ai_terms": F.when(lower, F.array_join("_v.ai_terms", ", ")).otherwise(F.col("ai_terms")),
        "reason": F.when(lower, F.col("_v.reason")).otherwise(F.col("reason")),
        "tier": F.when(lower, F.col("_v.tier")).otherwise(F.col("tier")),
    }).select(*jobs.columns)


# --- descriptions --------------------------------------------------------------------


def read_descriptions(found: DataFrame, as_of: int) -> DataFrame:
    """Rows of the descriptions table for texts just read: ``(uid, text, error)``."""
    plain = found.withColumn("_plain", plain_description(F.col("text")))
    scored = plain.withColumn("_terms", description_terms(F.col("_plain")))
    return scored.select(
        "uid", _now(as_of).alias("checked_at"), F.size("_terms").alias("score"),
        F.array_join("_terms", ", ").alias("terms"),
        F.nullif(F.col("error"), F.lit("")).alias("error"))


def record_descriptions(descriptions: DataFrame, read: DataFrame) -> DataFrame:
    """The latest read of each uid."""
    return last_by(descriptions.unionByName(read), ["uid"], ["checked_at"])


def requeue_descriptions(descriptions: DataFrame, jobs: DataFrame, as_of: int,
                         cfg: Settings = DEFAULT) -> DataFrame:
    """Forget reads that new description rules may judge otherwise."""
    since = as_of - cfg.max_age_hours * 3600
    again = jobs.where((F.col("tier") == "loose") & (F.col("reason") == NO_AI)
                       & (shown_at() >= since)).select("uid")
    return descriptions.join(again, "uid", "left_anti")


DESCRIPTION_RULES = "descriptions"


def requeue_for_rules(descriptions: DataFrame, jobs: DataFrame, rules: DataFrame, as_of: int,
                      cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The descriptions and rules tables for a run: requeued once for each set of rules.

    Under the rules that the state names nothing moves. Under others the reads they
    may judge otherwise are forgotten, so that the backlog takes these rows up again.
    """
    version = rules_version(cfg)
    own = F.col("name") == DESCRIPTION_RULES
    if not rules.where(own & (F.col("version") == version)).isEmpty():
        return descriptions, rules
    now = rules.sparkSession.createDataFrame([(DESCRIPTION_RULES, version)], RULES_SCHEMA)
    return (requeue_descriptions(descriptions, jobs, as_of, cfg),
            rules.where(~own).unionByName(now))


def description_backlog(jobs: DataFrame, descriptions: DataFrame, limit: int | None, as_of: int,
                        cfg: Settings = DEFAULT) -> DataFrame:
    """Stored rows a description may promote, newest first; no limit reads all."""
    since = as_of - cfg.max_age_hours * 3600
    open_ = ((F.col("tier") == "loose") & (F.col("reason") == NO_AI)) | (
        F.col("tier").isNull() & (F.col("reason") == NO_PLACE))
    rows = jobs.where(open_ & (shown_at() >= since)).join(
        descriptions.select("uid"), "uid", "left_anti")
    ordered = rows.orderBy(shown_at().desc(), "uid")
    return ordered if limit is None else ordered.limit(limit)


def apply_descriptions(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Fill places and dates the posting's own page gives, and attach its text.

    ``described(uid, text, place, posted)``; the text lands in ``description``.
    """
    joined = rows.join(described, "uid", "left")
    says = F.coalesce("place", F.lit("")) != ""
    return joined.withColumns({
        "location": F.when(says & ~names_a_place(F.col("location")), F.col("place"))
        .otherwise(F.col("location")),
        "posted_at": F.when((F.col("posted_at") == 0) & (F.coalesce("posted", F.lit(0)) > 0),
                            F.col("posted")).otherwise(F.col("posted_at")),
        "description": F.col("text"),
    }).drop("text", "place", "posted")


def backfill(jobs: DataFrame, descriptions: DataFrame, described: DataFrame, as_of: int,
             cfg: Settings = DEFAULT) -> DataFrame:
    """Re-read the stored backlog; only promotions are written, places are filled."""
    backlog = description_backlog(jobs, descriptions, None, as_of, cfg)
    known = backlog.join(described.select("uid"), "uid", "left_semi")
    bare = known.select("uid", "company", "title", "location", "posted_at").withColumns({
        "loc_extra": F.array().cast("array<string>"),
        "cycle_extra": F.array().cast("array<string>"),
        "employment_type": F.lit(""), "country": F.lit(""), "ai_native": F.lit(False)})
    fresh = classify(apply_descriptions(bare, described), as_of, cfg, "description").select(
        "uid", F.col("location").alias("_location"), F.col("posted_at").alias("_posted"),
        F.col("verdict").alias("_v"))
    joined = jobs.join(fresh, "uid", "left")
    met = F.col("_v").isNotNull()
    higher = met & (tier_rank(F.col("_v.tier")) > tier_rank(F.col("tier")))
    moved = met & ~F.col("_location").eqNullSafe(F.coalesce("location", F.lit("")))
    return joined.withColumns({
        "ai_terms": F.when(higher, F.array_join("_v.ai_terms", ", ")).otherwise(
            F.col("ai_terms")),
        "reason": F.when(higher, F.col("_v.reason")).otherwise(F.col("reason")),
        "posted_at": F.when(moved & (F.col("posted_at") == 0), F.col("_posted")).otherwise(
            F.col("posted_at")),
        "location": F.when(moved, F.col("_location")).otherwise(F.col("location")),
        "tier": F.when(higher, F.col("_v.tier")).otherwise(F.col("tier")),
    }).select(*jobs.columns)


# --- health ---------------------------------------------------------------------------


def upsert_health(health: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fold fetch outcomes ``(source, at, ok, rows, error)`` into the health table.

    The count kept is the last non-zero one, so an unchanged payload never
    reads as empty; a failure touches only the error and the flag.
    """
    good, counted = F.col("ok"), F.col("ok") & (F.col("rows") > 0)
    latest = outcomes.groupBy("source").agg(
        F.max(F.when(good, F.col("at"))).alias("_success"),
        F.max_by(F.when(counted, F.col("rows")),
                 F.when(counted, F.struct("at", "rows"))).alias("_count"),
        F.max_by(F.when(~good, F.col("error")),
                 F.when(~good, F.struct("at", "error"))).alias("_error"),
        F.max(F.when(~good, F.col("at"))).alias("_error_at"),
        F.max(F.struct("at", "ok")).alias("_last"))
    joined = health.join(latest, "source", "full_outer")
    return joined.select(
        "source",
        F.coalesce("_success", "last_success").alias("last_success"),
        F.coalesce("_error", "last_error").alias("last_error"),
        F.coalesce("_error_at", "last_error_at").alias("last_error_at"),
        F.coalesce("_count", "job_count", F.lit(0)).cast("bigint").alias("job_count"),
        F.coalesce("_last.ok", "ok").alias("ok"))


# --- discovered boards, candidates, hosts --------------------------------------------


def upsert_discovered(discovered: DataFrame, boards: DataFrame, as_of: int) -> DataFrame:
    """Add boards ``(platform, token, name, hits)``, or renew the evidence for them."""
    seen = boards.groupBy(*BOARD).agg(
        F.max("hits").alias("_hits"), F.max_by("name", "hits").alias("_name"))
    joined = discovered.join(seen, BOARD, "full_outer")
    met = F.col("_hits").isNotNull()
    return joined.select(
        *BOARD, F.coalesce("name", "_name").alias("name"),
        F.coalesce("first_seen", _now(as_of)).alias("first_seen"),
        F.when(met, _now(as_of)).otherwise(F.col("last_canada")).alias("last_canada"),
        "last_ok", "last_error", F.coalesce("fails", F.lit(0)).alias("fails"),
        F.greatest(F.coalesce("canada_hits", F.lit(0)), F.coalesce("_hits", F.lit(0)))
        .cast("bigint").alias("canada_hits"),
        F.coalesce("job_count", F.lit(0)).cast("bigint").alias("job_count"), "last_attempt",
        F.coalesce("student_jobs", F.lit(0)).cast("bigint").alias("student_jobs"),
        F.coalesce("strict_jobs", F.lit(0)).cast("bigint").alias("strict_jobs"),
        F.coalesce("ok_streak", F.lit(0)).alias("ok_streak"))


def discovered_outcome(discovered: DataFrame, outcomes: DataFrame, as_of: int) -> DataFrame:
    """Record one scrape per board: ``(platform, token, jobs, canada, student, strict, error)``.

    The streak climbs while student roles come back and falls below zero
    while they do not; a failure only counts itself.
    """
    o = outcomes.select(*BOARD, *[F.col(c).alias(f"_{c}") for c in
                                  ("jobs", "canada", "student", "strict", "error")],
                        F.lit(True).alias("_met"))
    joined = discovered.join(o, BOARD, "left")
    met = F.coalesce("_met", F.lit(False))
    failed = met & F.col("_error").isNotNull()
    good = met & F.col("_error").isNull()
    streak = F.coalesce("ok_streak", F.lit(0))
    step = F.when(F.col("_student") > 0, F.when(streak > 0, streak + 1).otherwise(1)).otherwise(
        F.when(streak < 0, streak - 1).otherwise(-1))

    def pick(when_good: Column, old: str) -> Column:
        return F.when(good, when_good).otherwise(F.col(old))

    found = F.col("_canada") > 0
    return joined.withColumns({
        "last_ok": pick(_now(as_of), "last_ok"),
        "last_attempt": F.when(met, _now(as_of)).otherwise(F.col("last_attempt")),
        "last_error": F.when(failed, F.col("_error")).when(good, None).otherwise(
            F.col("last_error")),
        "fails": F.when(good, 0).when(failed, F.col("fails") + 1).otherwise(F.col("fails")),
        "job_count": pick(F.col("_jobs"), "job_count"),
        "student_jobs": pick(F.col("_student"), "student_jobs"),
        "strict_jobs": pick(F.col("_strict"), "strict_jobs"),
        "ok_streak": pick(step, "ok_streak").cast("int"),
        "canada_hits": F.when(good & found, F.col("_canada")).otherwise(F.col("canada_hits")),
        "last_canada": F.when(good & found, _now(as_of)).otherwise(F.col("last_canada")),
    }).select(*discovered.columns)


def upsert_candidates(candidates: DataFrame, boards: DataFrame, as_of: int) -> DataFrame:
    """Remember linked boards ``(platform, token, name, hits)``; links keep their maximum."""
    seen = boards.groupBy(*BOARD).agg(
        F.max("hits").alias("_hits"), F.max_by("name", "hits").alias("_name"))
    joined = candidates.join(seen, BOARD, "full_outer")
    met = F.col("_hits").isNotNull()
    return joined.select(
        *BOARD, F.coalesce("name", "_name").alias("name"),
        F.greatest(F.coalesce("links", F.lit(0)), F.coalesce("_hits", F.lit(0)))
        .cast("bigint").alias("links"),
        F.coalesce("first_seen", _now(as_of)).alias("first_seen"),
        F.when(met, _now(as_of)).otherwise(F.col("last_seen")).alias("last_seen"),
        "checked_at", F.coalesce("canada", F.lit(0)).cast("bigint").alias("canada"),
        F.coalesce("student", F.lit(0)).cast("bigint").alias("student"), "result")


def candidates_checked(candidates: DataFrame, results: DataFrame, as_of: int) -> DataFrame:
    """Store the check of candidates: ``(platform, token, canada, student, result)``."""
    r = results.select(*BOARD, *[F.col(c).alias(f"_{c}") for c in
                                 ("canada", "student", "result")], F.lit(True).alias("_met"))
    joined = candidates.join(r, BOARD, "left")
    met = F.coalesce("_met", F.lit(False))
    return joined.withColumns({
        "checked_at": F.when(met, _now(as_of)).otherwise(F.col("checked_at")),
        "canada": F.when(met, F.col("_canada")).otherwise(F.col("canada")),
        "student": F.when(met, F.col("_student")).otherwise(F.col("student")),
        "result": F.when(met, F.col("_result")).otherwise(F.col("result")),
    }).select(*candidates.columns)


def upsert_hosts(hosts: DataFrame, found: DataFrame, as_of: int) -> DataFrame:
    """Remember careers hosts ``(host, url, name, hits)``: newest link and name, most hits."""
    seen = found.select("host", F.col("url").alias("_url"), F.col("name").alias("_name"),
                        F.col("hits").alias("_hits"))
    joined = hosts.join(seen, "host", "full_outer")
    met = F.col("_hits").isNotNull()
    return joined.select(
        "host", F.coalesce("_url", "sample_url").alias("sample_url"),
        F.coalesce("_name", "name").alias("name"),
        F.greatest(F.coalesce("hits", F.lit(0)), F.coalesce("_hits", F.lit(0)))
        .cast("bigint").alias("hits"),
        F.when(met, _now(as_of)).otherwise(F.col("last_seen")).alias("last_seen"),
        "last_sniffed", "result")


def hosts_sniffed(hosts: DataFrame, results: DataFrame, as_of: int) -> DataFrame:
    r = results.select("host", F.col("result").alias("_result"), F.lit(True).alias("_met"))
    joined = hosts.join(r, "host", "left")
    met = F.coalesce("_met", F.lit(False))
    return joined.withColumns({
        "last_sniffed": F.when(met, _now(as_of)).otherwise(F.col("last_sniffed")),
        "result": F.when(met, F.col("_result")).otherwise(F.col("result")),
    }).select(*hosts.columns)
