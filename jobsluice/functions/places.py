"""Where a location text puts a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.patterns import any_of, commute_terms, far_terms, ontario_terms

IN_SCOPE = ["ontario", "canada"]


def names_ontario(text: Column) -> Column:
    return text.rlike(any_of(ontario_terms()))


def names_commute(text: Column) -> Column:
    return text.rlike(any_of(commute_terms()))


def names_far(text: Column) -> Column:
    return text.rlike(any_of(far_terms()))


def names_other_canada(text: Column) -> Column:
    return text.rlike(any_of(vocab.OTHER_CANADA_TERMS))


def names_canada(text: Column) -> Column:
    return text.rlike(any_of(vocab.CANADA_TERMS))


def is_remote(text: Column) -> Column:
    return text.rlike(any_of(vocab.REMOTE_TERMS))


def names_foreign(text: Column) -> Column:
    return text.rlike(any_of(vocab.FOREIGN_TERMS)) | text.rlike(vocab.FOREIGN_UPPER)


def location_scope(text: Column) -> Column:
    """ontario, far, canada, elsewhere or unknown.

    Ontario named anywhere decides first; remote work within Canada counts as
    Ontario; Ontario places that are all too far to commute are ``far``.
    """
    remote, canada, other = is_remote(text), names_canada(text), names_other_canada(text)
    too_far = names_far(text) & ~names_commute(text) & ~remote
    return (
        F.when(names_ontario(text) | (canada & remote & ~other),
               F.when(too_far, "far").otherwise("ontario"))
        .when(other, "elsewhere")
        .when(names_foreign(text), "elsewhere")
        .when(canada, "canada")
        .otherwise("unknown")
    )


def names_a_place(location: Column) -> Column:
    return location_scope(F.coalesce(location, F.lit(""))) != "unknown"


def in_canada(scope_text: Column) -> Column:
    return location_scope(scope_text).isin(IN_SCOPE)
