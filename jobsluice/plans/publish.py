"""What is published from the jobs table, as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsluice.functions.classify import AI_IN_DESCRIPTION
from jobsluice.functions.clean import safe_url
from jobsluice.functions.dates import is_today, when_label
from jobsluice.functions.render import md_escape, md_url, xml_escape
from jobsluice.operators.feed import recent_jobs, undated_seed
from jobsluice.settings import DEFAULT, Settings

# What a tier is called where it is shown.
CARD_TAG = {"strict": "s", "loose": "l", "other": "o"}


def _utc(seconds: Column, fmt: str) -> Column:
    """UTC wall-clock text, whatever the session's zone."""
    return F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), fmt)


def feed_items(jobs: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Strict then loose roles of the feed window, ranked; unsafe links are left out."""
    parts = []
    for rank, (tier, hours) in enumerate((("strict", cfg.strict_window),
                                          ("loose", cfg.max_age_hours))):
        parts.append(recent_jobs(jobs, tier, as_of, cfg.feed_limit, hours, cfg).withColumn(
            "_tier_rank", F.lit(rank)))
    safe = parts[0].unionByName(parts[1]).where(safe_url(F.col("url")) != "")
    order = [F.asc("_tier_rank"), undated_seed().asc(), F.desc("shown_at"), F.asc("uid")]
    top = safe.orderBy(*order).limit(cfg.feed_limit)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        F.col("uid").alias("id"), "tier", "title", "company",
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("term", F.lit("")).alias("term"), "url",
        F.when(F.col("shown_at") > 0, F.concat(
            _utc(F.col("shown_at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .otherwise("").alias("date"),
        (F.coalesce("posted_at", F.lit(0)) != 0).alias("date_known"),
        F.coalesce("ai_terms", F.lit("")).alias("ai_terms"),
        "shown_at")


def rss_items(items: DataFrame) -> DataFrame:
    """One escaped ``<item>`` per feed item."""
    place = F.when(F.col("location") == "", "location not listed").otherwise(F.col("location"))
    bits = F.concat_ws(" · ", "company", place, F.nullif("term", F.lit("")))
    stamp = F.when(F.col("date") != "", F.concat(
        F.lit("<pubDate>"), _utc(F.col("shown_at"), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" +0000</pubDate>"))).otherwise("")
    item = F.concat(
        F.lit("<item><title>"), xml_escape(F.concat("title", F.lit(" at "), "company")),
        F.lit("</title><link>"), xml_escape(F.col("url")),
        F.lit('</link><guid isPermaLink="false">'), xml_escape(F.col("id")),
        F.lit("</guid><category>"), F.when(F.col("tier") == "strict", "AI/ML").otherwise("Tech"),
        F.lit("</category><description>"), xml_escape(bits), F.lit("</description>"), stamp,
        F.lit("</item>"))
    return items.select("rank", item.alias("item"))


def ai_note() -> Column:
    """Why a role is AI work when its title does not say so."""
    said = F.coalesce("ai_terms", F.lit(""))
    return F.when((F.col("reason") == AI_IN_DESCRIPTION) & (said != ""), F.concat(
        F.lit(f"{AI_IN_DESCRIPTION}: "), said)).otherwise("")


def _age(as_of: int, cfg: Settings) -> tuple[Column, Column]:
    args = (F.col("posted_at"), F.col("seeded"), F.col("shown_at"), as_of, cfg)
    return when_label(*args), is_today(*args)


def markdown_rows(roles: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> DataFrame:
    """One escaped five-column table row per role."""
    when, today = _age(as_of, cfg)
    title, link, note = md_escape(F.col("title")), md_url(F.col("url")), ai_note()
    place = F.coalesce(F.nullif("location", F.lit("")), F.lit("not listed"))
    head = F.when(link != "", F.concat(F.lit("| ["), title, F.lit("]("), link, F.lit(") "))) \
        .otherwise(F.concat(F.lit("| "), title, F.lit(" ")))
    extra = F.when(note != "", F.concat(
        F.lit("<br><sub>"), md_escape(note), F.lit("</sub> "))).otherwise("")
    age = F.when(today, F.concat(F.lit("**"), md_escape(when), F.lit("**"))).otherwise(
        md_escape(when))
    term = F.coalesce(F.nullif(md_escape(F.col("term")), F.lit("")), F.lit("-"))
    line = F.concat(head, extra, F.lit("| "), md_escape(F.col("company")), F.lit(" | "),
                    md_escape(place), F.lit(" | "), term, F.lit(" | "), age, F.lit(" |"))
    return roles.select("uid", line.alias("line"))


def html_cards(roles: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> DataFrame:
    """One escaped card per role."""
    when, today = _age(as_of, cfg)
    link, title, note = safe_url(F.col("url")), xml_escape(F.col("title")), ai_note()
    tag = None
    for tier, letter in CARD_TAG.items():
        test = F.col("tier") == tier
        tag = F.when(test, letter) if tag is None else tag.when(test, letter)
    place = F.coalesce(F.nullif("location", F.lit("")), F.lit("location not listed"))
    term = F.coalesce("term", F.lit(""))
    name = F.when(link != "", F.concat(
        F.lit('<a class="title" href="'), xml_escape(link),
        F.lit('" target="_blank" rel="noopener noreferrer">'), title, F.lit("</a>"))).otherwise(
        F.concat(F.lit('<span class="title">'), title, F.lit("</span>")))
    card = F.concat(
        F.lit('<div class="card"><span class="tag '), tag, F.lit('">'), F.col("tier"),
        F.lit("</span>"), name,
        F.when(note != "", F.concat(F.lit('<span class="tag ai">'), xml_escape(note),
                                    F.lit("</span>"))).otherwise(""),
        F.lit('<span class="meta">'), xml_escape(F.col("company")), F.lit(" &middot; "),
        xml_escape(place),
        F.when(term != "", F.concat(F.lit(" &middot; "), xml_escape(term))).otherwise(""),
        F.lit('</span><span class="when'), F.when(today, " hot").otherwise(""), F.lit('">'),
        xml_escape(when), F.lit("</span></div>"))
    return roles.select("uid", card.alias("card"))


def feed_changed(new: DataFrame, published: DataFrame) -> DataFrame:
    """One row: does the new feed differ from the published one, rows and order alike?

    Only shown columns are compared, so a moved timestamp alone changes nothing.
    """
    columns = [c for c in new.columns if c != "shown_at"]
    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*columns).withColumn("_sign", F.lit(sign))
    both = counted(new, 1).unionByName(counted(published, -1))
    uneven = both.groupBy(*columns).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    return uneven.agg((F.count("*") > 0).alias("changed"),
                      F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("rows_changed"))


def alert_rows(fresh: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The first new strict roles to alert on, and how many more there are.

    ``fresh`` are new, fresh strict postings with ``seq``, ``verdict`` and ``term``.
    """
    top = fresh.orderBy("seq").limit(cfg.alert_limit)
    total = fresh.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    term = F.when((F.col("verdict.cycle") == "target") & (F.col("term") != ""), F.concat(
        F.lit("  ("), "term", F.lit(")"))).otherwise("")
    body = F.concat("company", F.lit(" - "), F.coalesce(
        F.nullif("location", F.lit("")), F.lit("location not listed")), term)
    return top.withColumn("_one", F.lit(1)).join(total, "_one").select(
        "seq", "title", body.alias("body"), safe_url(F.col("url")).alias("link"),
        F.greatest(F.col("_total") - cfg.alert_limit, F.lit(0)).alias("more"))


def role_pages(jobs: DataFrame, as_of: int, cfg: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Lines of every published page, newest role first; each has at most ``feed_limit``."""
    pages = {}
    for tier in CARD_TAG:
        hours = cfg.strict_window if tier == "strict" else cfg.max_age_hours
        roles = recent_jobs(jobs, tier, as_of, cfg.feed_limit, hours, cfg)
        pages[f"markdown/{tier}"] = markdown_rows(roles, as_of, cfg).select("line")
        pages[f"cards/{tier}"] = html_cards(roles, as_of, cfg).select("card")
    return pages


def _published(spark: SparkSession, path: str, schema: str | T.StructType | None = None
               ) -> DataFrame | None:
    """What stands at a path, as JSON rows of a schema or as lines; None before the first run."""
    try:
        return spark.read.text(path) if schema is None else spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_pages(jobs: DataFrame, folder: str, as_of: int, cfg: Settings = DEFAULT) -> list[str]:
    """Write the pages whose lines differ from what is published; returns their names."""
    spark, written = jobs.sparkSession, []
    for name, rows in role_pages(jobs, as_of, cfg).items():
        path = f"{folder.rstrip('/')}/{name}"
        # The feed's limit bounds both sides.
        lines = [r[0] for r in rows.collect()]
        before = _published(spark, path)
        if before is None or [r[0] for r in before.collect()] != lines:
            spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode(
                "overwrite").option("lineSep", "\n").text(path)
            written.append(name)
    return written


def publish(jobs: DataFrame, folder: str, as_of: int, cfg: Settings = DEFAULT) -> bool:
    """Write feed, markdown tables and cards, each unless it equals what is published."""
    pages = publish_pages(jobs, folder, as_of, cfg)
    items = feed_items(jobs, as_of, cfg)
    path = f"{folder.rstrip('/')}/feed"
    published = _published(jobs.sparkSession, f"{path}/json", items.schema)
    if published is not None and not feed_changed(items, published).first()["changed"]:
        return bool(pages)
    # The files compared above are replaced here; the feed itself does not read them.
    items.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    rss_items(items).select("item").coalesce(1).write.mode("overwrite").text(f"{path}/rss")
    return True
