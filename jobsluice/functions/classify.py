"""The rule classifier: one pass of column expressions over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import cycle_blob, location_blob
from jobsluice.functions.cycles import cycle_verdict, names_live_cycle, parse_cycles, title_cycles
from jobsluice.functions.describe import (
    description_is_ai, description_terms, plain_description)
from jobsluice.functions.places import location_scope
from jobsluice.functions.patterns import any_of
from jobsluice.settings import DEFAULT, Settings

AI_IN_DESCRIPTION = "AI in description"
NO_AI = "no AI signal"
NO_PLACE = "no Canadian location"
CYCLE_REASONS = ["earlier cycle", "later cycle", "cycle already passed"]

# The tier each verdict reason belongs to; the rest are rejected.
REASON_TIER = {
    "off-field": "other",
    "not tech": "other",
    "Canada, province not named": "loose",
    NO_AI: "loose",
    "new grad, not internship": "loose",
    "later cycle": "loose",
    "earlier cycle": "loose",
    AI_IN_DESCRIPTION: "strict",
    "ai + student + ontario": "strict",
}
TIER_RANK = {"other": 1, "loose": 2, "strict": 3}
VERDICT_TYPE = (
    "struct<tier:string,reason:string,ai:boolean,student:boolean,ontario:boolean,"
    "location_known:boolean,cycle:string,ai_terms:array<string>>"
)


def has_ai_signal(title: Column) -> Column:
    return title.rlike(any_of(vocab.AI_TERMS))


def is_student(text: Column) -> Column:
    return text.rlike(any_of(vocab.STUDENT_TERMS))


def is_new_grad(text: Column) -> Column:
    return ~is_student(text) & text.rlike(any_of(vocab.NEWGRAD_TERMS))


def is_off_field(title: Column) -> Column:
    return title.rlike(any_of(vocab.OFF_FIELD_TERMS))


def is_tech(title: Column) -> Column:
    return title.rlike(any_of(vocab.TECH_TERMS)) | title.rlike(vocab.TECH_UPPER)


def is_retail(title: Column) -> Column:
    return title.rlike(any_of(vocab.RETAIL_TERMS))


def is_reject(text: Column) -> Column:
    return text.rlike(any_of(vocab.REJECT_TERMS))


def tier_of(reason: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, tier in REASON_TIER.items():
        expr = F.when(reason == name, tier).otherwise(expr)
    return expr


def tier_rank(tier: Column) -> Column:
    expr = F.lit(0)
    for name, rank in TIER_RANK.items():
        expr = F.when(tier == name, rank).otherwise(expr)
    return expr


def wants_description(tier: Column, reason: Column) -> Column:
    """Could the posting's own page change this verdict?"""
    return F.coalesce((tier == "loose") & (reason == NO_AI), F.lit(False)) | (
        tier.isNull() & (reason == NO_PLACE))


def classify(df: DataFrame, as_of: int | Column, cfg: Settings = DEFAULT,
             description: str | None = None) -> DataFrame:
    """``df`` with a ``verdict`` struct.

    Each stage is evaluated only for rows the stage before left open, and each
    vocabulary is matched once per row. ``description`` names a column whose
    text may make a tech title AI work.
    """
    keep = df.columns
    title = F.coalesce(F.col("title"), F.lit(""))
    text = df.withColumns({
        "_place": location_blob(F.col("location"), F.col("loc_extra"), F.col("country"),
                                F.col("employment_type")),
        "_terms": cycle_blob(F.col("cycle_extra"), F.col("employment_type")),
    }).withColumn("_all", F.concat(
        title, F.lit(" | "), F.coalesce(F.col("company"), F.lit("")), F.lit(" | "),
        F.col("_place")))

    # Level: 2 intern, 1 new grad, 0 neither; null where already rejected.
    level_text = F.concat(title, F.lit(" | "), F.col("_place"))
    level = (
        F.when(is_student(level_text), 2)
        .when(level_text.rlike(any_of(vocab.NEWGRAD_TERMS)), 1)
        .when(names_live_cycle(title_cycles(title, F.col("_terms"), as_of, cfg), cfg), 2)
        .otherwise(0)
    )
    levelled = text.withColumn("_level", F.when(~is_reject(F.col("_all")), level))
    placed = levelled.withColumn(
        "_scope", F.when(F.col("_level") > 0, location_scope(F.col("_place"))))
    cycles = parse_cycles(F.concat(F.col("_all"), F.lit(" | "), F.col("_terms")), as_of, cfg)
    dated = placed.withColumn(
        "_cycles", F.when(F.col("_scope").isin("ontario", "canada"), cycles))
    dated = dated.withColumn("_cycle", cycle_verdict(F.col("_cycles"), cfg))
    open_ = F.col("_cycle") != "past"
    titled = dated.withColumn(
        "_ai", F.when(open_, F.coalesce(F.col("ai_native"), F.lit(False)) | has_ai_signal(title)))
    sorted_ = titled.withColumn("_field", F.when(
        ~F.col("_ai"),
        F.when(is_retail(title), "store or shift role").when(is_off_field(title), "off-field")
        .when(~is_tech(title), "not tech")))

    none = F.array().cast("array<string>")
    if description is None:
        read = sorted_.withColumns({"_from_text": F.lit(False), "_found": none})
    else:
        asks = ~F.col("_ai") & F.col("_field").isNull() & (F.col(description) != "")
        read = sorted_.withColumn("_plain", F.when(asks, plain_description(F.col(description))))
        read = read.withColumn(
            "_found", F.when(F.col("_plain").isNotNull(), description_terms(F.col("_plain"))))
        read = read.withColumn("_from_text", F.coalesce(
            description_is_ai(F.col("_plain"), F.col("_found"), cfg)
            & F.col("_plain").isNotNull(), F.lit(False)))

    cycle, scope = F.col("_cycle"), F.col("_scope")
    reason = (
        F.when(F.col("_level").isNull(), "reject term")
        .when(F.col("_level") == 0, "not student level")
        .when(scope == "far", "outside commute area")
        .when(scope == "elsewhere", "outside Ontario")
        .when(scope == "unknown", NO_PLACE)
        .when(cycle == "past", "cycle already passed")
        .when(F.col("_field").isNotNull(), F.col("_field"))
        .when(scope == "canada", "Canada, province not named")
        .when(~F.col("_ai") & ~F.col("_from_text"), NO_AI)
        .when(F.col("_level") == 1, "new grad, not internship")
        .when(cycle == "later", "later cycle")
        .when(cycle == "earlier", "earlier cycle")
        .when(F.col("_from_text"), AI_IN_DESCRIPTION)
        .otherwise("ai + student + ontario")
    )
    decided = read.withColumn("_reason", reason)
    why = F.col("_reason")
    undated = why.isin("reject term", "not student level", "outside commute area",
                       "outside Ontario", NO_PLACE, "store or shift role")
    unplaced = why.isin("reject term", "not student level", "outside commute area",
                        "outside Ontario", NO_PLACE, "Canada, province not named")
    is_ai = F.col("_ai") | F.col("_from_text")
    by_field = why.isin("store or shift role", "off-field", "not tech")
    verdict = F.struct(
        tier_of(why).alias("tier"),
        why.alias("reason"),
        F.coalesce(is_ai & ~by_field, F.lit(False)).alias("ai"),
        (~why.isin("reject term", "not student level")).alias("student"),
        F.when(unplaced, False).when(by_field, scope == "ontario").otherwise(True)
        .alias("ontario"),
        ((why != NO_PLACE) | (F.trim(F.col("_place")) != "")).alias("location_known"),
        F.when(undated, "unknown").otherwise(cycle).alias("cycle"),
        F.when(F.col("_from_text") & ~unplaced, F.col("_found")).otherwise(none)
        .alias("ai_terms"),
    )
    # A generator, so that filters on the verdict stay above it: pushed below,
    # each would repeat every rule it depends on.
    return decided.select(*keep, F.explode(F.array(verdict)).alias("verdict"))
