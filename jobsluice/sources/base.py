"""The landing zone, the posting row, and helpers every source shares.

``listings_raw(source, platform, token, company, country, fetched_at, page_seq,
complete, body)`` holds one landed page of one listing per row. A source turns
its rows into listing rows: the posting columns plus where the row was met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import (
    clean_str, flatten_json, join_distinct_array, let, strip)

LANDED_SCHEMA = (
    "source string, platform string, token string, company string, country string, "
    "fetched_at bigint, page_seq int, complete boolean, body string"
)
POSTING_SCHEMA = (
    "company string, title string, location string, url string, uid string, source string, "
    "ai_native boolean, posted_at bigint, loc_extra array<string>, cycle_extra array<string>, "
    "employment_type string, country string, short_url string, inline_description string"
)
POSTING_COLUMNS = [part.split()[0] for part in POSTING_SCHEMA.split(", ")]
ARRIVAL_COLUMNS = ["fetched_at", "page_seq", "pos", "complete"]
LISTING_COLUMNS = POSTING_COLUMNS + ARRIVAL_COLUMNS

Source = Callable[[DataFrame, "int | Column"], DataFrame]
SOURCES: dict[str, Source] = {}


def source(platform: str) -> Callable[[Source], Source]:
    """Register the function that reads a platform's landed pages."""
    def add(fn: Source) -> Source:
        SOURCES[platform] = fn
        return fn
    return add


def normalize(landed: DataFrame, as_of: int | Column, platforms: list[str] | None = None
              ) -> DataFrame:
    """Listing rows of every registered platform found in the landing table.

    Each branch filters on ``platform``, the landing table's partition column,
    so a branch reads its own files only.
    """
    names = sorted(SOURCES) if platforms is None else platforms
    parts = [SOURCES[p](landed.where(F.col("platform") == p), as_of) for p in names]
    if not parts:
        arrival = "fetched_at bigint, page_seq int, pos int, complete boolean"
        return landed.sparkSession.createDataFrame([], f"{POSTING_SCHEMA}, {arrival}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# --- JSON records ------------------------------------------------------------------

NO_STRINGS = "array<string>"


def strings() -> Column:
    return F.array().cast(NO_STRINGS)


def records(landed: DataFrame, *paths: str) -> DataFrame:
    """One row per record of the first array found at one of the paths."""
    doc = F.try_parse_json(F.col("body"))
    found = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in paths])
    return landed.select(*[c for c in landed.columns if c != "body"],
                         F.posexplode(found).alias("pos", "job"))


def path_of(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def scalar(key: str, record: Column | str = "job") -> Column:
    """A record's value as clean text; missing reads as empty."""
    return clean_str(F.try_variant_get(record, path_of(key), "string"))


def items(key: str, record: Column | str = "job") -> Column:
    found = F.try_variant_get(record, path_of(key), "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def truthy(key: str, record: Column | str = "job") -> Column:
    return ~scalar(key, record).isin("", "false", "0", "null", "[]", "{}")


LABELS = "struct<" + ", ".join(f"{k}: string" for k in vocab.LABEL_KEYS) + ">"


def is_object(path: str, record: Column | str) -> Column:
    """Only an object reads as a struct."""
    return F.try_variant_get(record, path, LABELS).isNotNull()


def label_at(path: str, record: Column | str) -> Column:
    """The scalar at a path as text, or the first label-like field of the object there."""
    def first(fields: Column) -> Column:
        said = F.filter(F.array(*[strip(fields[k]) for k in vocab.LABEL_KEYS]), lambda x: x != "")
        return F.when(fields.isNotNull(), F.coalesce(F.get(said, 0), F.lit(""))).otherwise(
            clean_str(F.try_variant_get(record, path, "string")))

    # The fields are looked up in one go.
    return let(F.try_variant_get(record, path, LABELS), first)


def label_of(value: Column) -> Column:
    """A scalar as text, or an object's first label-like field."""
    return label_at("$", value)


def label(key: str, record: Column | str = "job") -> Column:
    """Clean text of a value that may be a scalar, an object or a list of either."""
    path = path_of(key)

    def text(value: Column) -> Column:
        said = F.filter(F.transform(F.try_variant_get(record, path, "array<variant>"), label_of),
                        lambda x: x != "")
        # Objects and lists read as JSON; so may a scalar, and is told from them there.
        return (F.when(value.startswith("["), F.coalesce(
                    F.array_join(said, ", "), label_at(path, record)))
                .when(value.startswith("{"), label_at(path, record))
                .otherwise(clean_str(value)))

    return let(F.try_variant_get(record, path, "string"), text)


def place(*parts: Column) -> Column:
    """Location text: strings and arrays of strings, distinct, joined by commas."""
    return join_distinct_array(F.concat(*parts))


def one(col: Column) -> Column:
    return F.array(col)


def each(key: str, *fields: str, record: Column | str = "job") -> Column:
    """For each object of a list, its named fields joined; scalars read as they are."""
    if not fields:
        return F.transform(items(key, record), label_of)
    shape = "array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>"
    found = F.coalesce(F.try_variant_get(record, path_of(key), shape), F.array().cast(shape))
    return F.transform(found, lambda x: join_distinct_array(F.array(*[x[f] for f in fields])))


def _fragments(keys: list[str], record: Column | str) -> Column:
    """The record's fields of these names as JSON, all looked up in one go."""
    shape = "struct<" + ", ".join(f"{k}: variant" for k in keys) + ">"
    return F.to_json(F.try_variant_get(record, "$", shape))


def flat(keys: list[str], record: Column | str = "job") -> Column:
    """Every string under the keys of a provider's record."""
    return flatten_json(_fragments(keys, record), enclosing=1)


def record_extras(record: Column | str = "job") -> dict[str, Column]:
    """The fields later stages read from a provider's whole record."""
    return {
        "loc_extra": flat(vocab.LOCATION_KEYS, record),
        "cycle_extra": flat(vocab.CYCLE_KEYS, record),
        "employment_type": F.array_join(flat(["employmentType"], record), " | "),
        "country": F.array_join(flat(["country"], record), " | "),
    }


def listing(df: DataFrame, **columns: Column) -> DataFrame:
    """Listing rows with the given columns; the rest take their defaults."""
    defaults = {
        "company": F.col("company"),
        "source": F.col("source"),
        "ai_native": F.lit(False),
        "posted_at": F.lit(0).cast("bigint"),
        "loc_extra": strings(),
        "cycle_extra": strings(),
        "employment_type": F.lit(""),
        "country": F.lit(""),
        "short_url": F.lit(""),
        "inline_description": F.lit(""),
        "location": F.lit(""),
        **{c: F.col(c) for c in ARRIVAL_COLUMNS},
    }
    chosen = {**defaults, **columns}
    return df.select(*[chosen[c].alias(c) for c in LISTING_COLUMNS])


def merge_pages(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per provider id of a listing: pages and search terms overlap.

    The last page met wins. An aggregate, not a window, so copies combine
    before the shuffle however many a single id has.
    """
    keys = keys or ("source", "uid", "fetched_at")
    rest = [c for c in rows.columns if c not in keys]
    order = [c for c in ("fetched_at", "page_seq", "pos") if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(latest).select(*keys, "row.*").select(*rows.columns)


def listing_complete(landed: DataFrame) -> DataFrame:
    """Is a source's listing whole? Not when any of its pages hit a cap."""
    return landed.groupBy("source", "fetched_at").agg(
        F.bool_and("complete").alias("complete"), F.count("*").alias("pages"))
