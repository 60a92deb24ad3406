"""Community trackers: a structured listings file, or tables in a README.

``files(source, company, repo, branch, path, fetched_at, body)`` holds landed
tracker files; ``company`` is the tracker's own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import (
    clean_str, collapse, join_distinct, join_distinct_array, strip_tags, unescape_html)
from jobsluice.functions.dates import first_date, parse_table_date
from jobsluice.operators.skew import first_by
from jobsluice.sources.base import (
    items, label, label_of, listing, record_extras, records, scalar)

FILE = ["source", "company", "repo", "branch", "path", "fetched_at"]
CELL, GAP = "\x1f", "\x1d"

# How tables, cells and links are written.
PIPE_ROW = r"^\s*\|[^|]*\|[^|]*\|"
HTML_TABLE = r"(?is)<table[^>]*>(.*?)</table>"
HTML_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
HTML_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
MD_LINK_TEXT = r"!?\[([^\]]*)\]\([^)]*\)"
MD_LINK = r"\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
BARE_LINK = r"""https?://[^\s)\]"'<>]+"""
ROW_ID = r"<!--\s*id:([^\s>-]+)\s*-->"
TITLE_SUFFIX = r"(?i)\s+Job Details\s*/.*$"


def season_of(*parts: Column) -> Column:
    """Season fields joined, without the words that mean no term is known."""
    return join_distinct_array(F.filter(
        F.concat(*parts), lambda t: ~F.lower(clean_str(t)).isin(vocab.SEASON_PLACEHOLDERS)))


def _as_list(key: str) -> Column:
    many = F.transform(items(key), label_of)
    return F.when(F.size(many) > 0, many).otherwise(F.array(label(key)))


def tracker_json(files: DataFrame, as_of: int | Column) -> DataFrame:
    """Rows of a tracker's listings file; hidden, closed and linkless items are left out."""
    def shown(key: str) -> Column:
        return F.coalesce(F.try_variant_get("job", f"$.{key}", "boolean"), F.lit(True))

    rows = records(files, "$").where(shown("active") & shown("is_visible")
                                     & (scalar("url") != ""))
    season = season_of(_as_list("season"), _as_list("terms"))
    url = scalar("url")
    key = F.coalesce(F.nullif(scalar("id"), F.lit("")), url)
    return listing(
        rows.withColumns({"page_seq": F.lit(0), "complete": F.lit(True)}), **record_extras(),
        source=F.col("company"),
        company=scalar("company_name"),
        title=F.when(season != "", join_distinct(scalar("title"), season))
        .otherwise(scalar("title")),
        location=label("locations"),
        url=url,
        uid=F.concat(F.lit("tracker:"), F.col("repo"), F.lit(":"), key),
        posted_at=first_date(scalar("date_posted"), scalar("date_updated"), as_of=as_of))


def _grids(files: DataFrame) -> DataFrame:
    """One row per table: its raw cells, row by row."""
    body = F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), r"\r\n?", "\n")
    # Lines outside pipe tables become gaps, so each run of table lines is one block.
    lines = F.transform(F.split(body, "\n"), lambda line: F.when(
        line.rlike(PIPE_ROW), line).otherwise(F.lit(GAP)))
    blocks = F.filter(F.split(F.array_join(lines, "\n"), GAP), lambda b: b.contains("|"))
    pipe = F.transform(blocks, lambda block: F.transform(
        F.filter(F.split(block, "\n"), lambda line: line != ""),
        lambda line: F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|")))
    marked = F.transform(
        F.regexp_extract_all(body, F.lit(HTML_TABLE), F.lit(1)),
        lambda t: F.filter(
            F.transform(F.regexp_extract_all(t, F.lit(HTML_ROW), F.lit(1)),
                        lambda r: F.regexp_extract_all(r, F.lit(HTML_CELL), F.lit(1))),
            lambda cells: F.size(cells) > 0))
    tables = files.select(*FILE, F.posexplode(F.concat(pipe, marked)).alias("table", "raw"))
    return tables.where(F.size("raw") >= 2)


def _cell_texts(cells: Column) -> Column:
    """Visible text of a row's cells, entity-decoded in one call.

    Row by row, so that what a batch hands to Python does not grow with the tables.
    """
    bare = F.array_join(F.transform(
        cells, lambda c: strip_tags(F.regexp_replace(c, MD_LINK_TEXT, "$1"))), CELL)
    return F.transform(F.split(unescape_html(bare), CELL),
                       lambda c: F.btrim(collapse(c), F.lit(" |*")))


def _fits(heads: Column, aliases: list[str], taken: list[Column]):
    """Does a header cell name the field, and is its column still free?"""
    def test(i: Column) -> Column:
        free = F.lit(True)
        for index in taken:
            free = free & ~F.coalesce(i == index, F.lit(False))
        return F.lower(F.get(heads, i)).rlike("|".join(aliases)) & free
    return test


def _mapped(tables: DataFrame) -> DataFrame:
    """Adds ``at_<field>`` column indexes, each resolved once from the header.

    Fields are taken in order; a column serves the first field that claims it.
    """
    heads, taken = F.col("heads"), []
    slots = F.sequence(F.lit(0), F.size(heads) - 1)
    for field, aliases in vocab.COLUMN_ALIASES.items():
        tables = tables.withColumn(
            f"at_{field}", F.get(F.filter(slots, _fits(heads, aliases, taken)), 0))
        taken = [*taken, F.col(f"at_{field}")]
    # No link column: the link sits on the title itself.
    return tables.where(F.col("at_title").isNotNull()).withColumn(
        "at_url", F.coalesce("at_url", "at_title"))


def table_rows(files: DataFrame, as_of: int | Column) -> DataFrame:
    """Job rows of every table of each file."""
    tables = _mapped(_grids(files).withColumn("heads", _cell_texts(F.get("raw", 0))))
    fields = list(vocab.COLUMN_ALIASES)
    width = F.greatest(*[F.coalesce(F.col(f"at_{f}"), F.lit(-1)) for f in fields])
    body = F.slice("raw", 2, F.size("raw"))
    rows = tables.select(*FILE, "table", *[f"at_{f}" for f in fields], width.alias("width"),
                         F.posexplode(body).alias("pos", "cells"))

    cell = F.get("cells", F.col("at_url"))
    links = F.concat(
        F.regexp_extract_all(cell, F.lit(HREF), F.lit(1)),
        F.regexp_extract_all(cell, F.lit(MD_LINK), F.lit(1)),
        F.transform(F.regexp_extract_all(cell, F.lit(BARE_LINK), F.lit(0)),
                    lambda u: F.regexp_replace(u, r"[>)]+$", "")))
    link = F.get(F.filter(links, lambda u: ~u.rlike(f"(?i){vocab.IMAGE_URL}")), 0)
    # Decoded together, both go through one Python worker a task.
    rows = rows.where(F.size("cells") > F.col("width")).withColumns({
        "text": _cell_texts(F.col("cells")),
        "url": unescape_html(F.coalesce(link, F.lit("")))})
    rows = rows.where(~F.array_join("text", " ").rlike(r"^[-: ]*$"))

    def text(field: str) -> Column:
        return F.coalesce(F.get("text", F.col(f"at_{field}")), F.lit(""))

    named = text("company")
    marks = "|".join(f"^{m}" for m in vocab.CONTINUATION_MARKS)
    own = F.when((named != "") & ~named.rlike(marks), named)
    # One table of one file is one landed value, so this window is bounded by it.
    above = Window.partitionBy(*FILE, "table").orderBy("pos")
    rows = rows.withColumn("company_name", F.coalesce(
        F.last(own, ignorenulls=True).over(above), F.lit("")))

    rows = rows.select(
        *FILE, "table", "pos", "company_name",
        F.regexp_replace(text("title"), TITLE_SUFFIX, "").alias("title"),
        text("location").alias("location"), "url",
        F.regexp_extract(F.array_join("cells", " "), ROW_ID, 1).alias("row_id"),
        parse_table_date(text("date"), as_of).alias("posted_at"),
        text("details").alias("details"))
    return rows.where((F.col("title") != "") & (F.col("url") != ""))


def tracker_tables(files: DataFrame, as_of: int | Column) -> DataFrame:
    rows = table_rows(files, as_of)
    key = F.coalesce(F.nullif(F.col("row_id"), F.lit("")), F.col("url"))
    return listing(
        rows.withColumns({"page_seq": F.col("table"), "complete": F.lit(True)}),
        source=F.col("company"),
        company=F.col("company_name"),
        title=F.col("title"),
        location=F.col("location"),
        url=F.col("url"),
        uid=F.concat(F.lit("tracker:"), F.col("repo"), F.lit(":"), key),
        loc_extra=F.array("location"),
        cycle_extra=F.array("details"),
        posted_at=F.col("posted_at"))


def tracker_choose(files: DataFrame, as_of: int | Column) -> DataFrame:
    """The file each tracker is read from, for each of its fetches.

    A listings file with items beats a README with rows; among files of a kind
    the branch decides, then the path.
    """
    is_json = F.col("path").endswith(".json")
    branch = F.array_position(F.array(*[F.lit(b) for b in vocab.TRACKER_BRANCHES]),
                              F.col("branch"))
    count = F.size(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))
    listings = files.where(is_json & (count > 0)).select(*FILE, F.lit(0).alias("kind"))
    readmes = table_rows(files.where(~is_json), as_of).select(*FILE).distinct().withColumn(
        "kind", F.lit(1))
    usable = listings.unionByName(readmes).withColumns(
        {"branch_rank": branch, "path_rank": F.length("path")})
    return first_by(usable, ["repo", "fetched_at"], F.struct(
        "kind", "branch_rank", -F.col("path_rank"), "path")).select(*FILE, "kind")


def tracker_listings(files: DataFrame, as_of: int | Column) -> DataFrame:
    """Listing rows of the file chosen for each fetch of a tracker."""
    of = ["repo", "branch", "path", "fetched_at"]
    picked = files.join(tracker_choose(files, as_of).select(*of, "kind"), of)
    return tracker_json(picked.where("kind = 0").drop("kind"), as_of).unionByName(
        tracker_tables(picked.where("kind = 1").drop("kind"), as_of))
