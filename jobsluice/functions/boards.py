"""Boards named by links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import authority, let


def workday_token(tenant: Column, wd: Column, site: Column) -> Column:
    return F.concat(F.lit("https://"), tenant, F.lit("."), wd, F.lit(".myworkdayjobs.com/wday/cxs/"),
                    tenant, F.lit("/"), site, F.lit("/jobs"))


def eightfold_token(name: Column) -> Column:
    low = F.lower(name)
    return F.concat(low, F.lit(".eightfold.ai|"), low, F.lit(".com"))


def board_of(url: Column) -> Column:
    """The board a posting link belongs to, as "platform token", or null.

    A plain text, so that the long chain of patterns is evaluated once; use
    ``with_board`` to add it to rows as two columns. A pattern is only tried on
    links that have its anchor.
    """
    return let(F.coalesce(url, F.lit("")), lambda link: let(
        F.lower(link), lambda low: _board_of(link, low)))


def _board_of(link: Column, low: Column) -> Column:
    def tried(pattern: str, board: Column) -> Column:
        return F.when(low.contains(vocab.BOARD_ANCHORS[pattern]), board)

    def whole(pattern: str, shape: str) -> Column:
        """The shape filled from the groups of a matching link."""
        flags = "(?i)" if pattern.startswith("(?i)") else ""
        full = f"(?s){flags}^.*?{pattern.removeprefix('(?i)')}.*$"
        return tried(pattern, F.when(link.rlike(pattern), F.regexp_replace(link, full, shape)))

    def site(platform: str, pattern: str, suffix: str = "") -> Column:
        host = F.lower(F.regexp_extract(link, pattern, 1))
        return tried(pattern, F.when(
            host != "", F.concat(F.lit(f"{platform} https://"), host, F.lit(suffix))))

    cxs = ".myworkdayjobs.com/wday/cxs/"
    oracle = vocab.ORACLE_POSTING
    eightfold = F.regexp_extract(link, vocab.EIGHTFOLD_POSTING, 1)
    boards = [
        whole(vocab.WORKDAY_POSTING, f"workday https://$1.$2{cxs}$1/$3/jobs"),
        whole(vocab.WORKDAY_SITE_POSTING, f"workday https://$2.$1{cxs}$2/$3/jobs"),
        tried(oracle, F.when(link.rlike(oracle), F.concat(
            F.lit("oracle https://"), F.lower(F.regexp_extract(link, oracle, 1)), F.lit("|"),
            F.regexp_extract(link, oracle, 2)))),
        tried(vocab.EIGHTFOLD_POSTING, F.when(
            eightfold != "", F.concat(F.lit("eightfold "), eightfold_token(eightfold)))),
        site("jibe", vocab.JIBE_POSTING),
        site("icims", vocab.ICIMS_POSTING),
        site("successfactors", vocab.SUCCESSFACTORS_POSTING,
             "/search/?q=&locationsearch=Ontario"),
    ]
    for platform, pattern in vocab.SLUG_POSTINGS:
        slug = F.regexp_extract(link, pattern, 1)
        named = ~F.lower(slug).isin("", *vocab.TOKEN_NOISE)
        boards.append(tried(pattern, F.when(named, F.concat(F.lit(f"{platform} "), slug))))
    return F.coalesce(*boards)


def with_board(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """Adds ``platform`` and ``token`` of the board each row's ``url`` belongs to.

    Rows that name no board are dropped unless ``keep_all``. The array
    generator keeps the optimiser from repeating the patterns in a filter.
    """
    # Columns of their own: bound inside the generator they would be read more slowly.
    linked = rows.withColumn("_link", F.coalesce("url", F.lit("")))
    linked = linked.withColumn("_low", F.lower("_link"))
    found = F.array(_board_of(F.col("_link"), F.col("_low")))
    one = F.explode(found if keep_all else F.array_compact(found)).alias("_board")
    return linked.select(*rows.columns, one).withColumns({
        "platform": F.split_part("_board", F.lit(" "), F.lit(1)),
        "token": F.split_part("_board", F.lit(" "), F.lit(2)),
    }).drop("_board")


def board_key(platform: Column, token: Column) -> Column:
    """Case-insensitive identity of a board; a SuccessFactors board is its site."""
    whole = F.lower(F.regexp_replace(token, "/+$", ""))
    return F.concat(platform, F.lit(" "), F.when(
        platform == "successfactors", authority(token)).otherwise(whole))


def is_denied_board(name: Column, token: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(token, F.lit(""))))
    return text.rlike("|".join(vocab.DENIED_BOARD_WORDS))
