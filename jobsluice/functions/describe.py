"""What a job description says about the work."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import let, strip_tags
from jobsluice.settings import DEFAULT, Settings


def plain_description(text: Column) -> Column:
    return strip_tags(F.coalesce(text, F.lit("")))


def _folded(plain: Column) -> Column:
    """Lower case as the patterns see it, which take these three letters for ``i`` and ``s``."""
    lower = F.lower(F.replace(plain, F.lit("\u0130"), F.lit("i")))
    return F.replace(F.replace(lower, F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s"))


def _pattern(pattern: str) -> Column:
    return F.lit(f"(?iU){pattern}")


def _anchored(folded: Column, label: str) -> Column:
    """Whether a match of the term is possible: a plain search for its anchor words."""
    found = [folded.contains(word) for word in vocab.DESCRIPTION_ANCHORS[label]]
    return reduce(lambda a, b: a | b, found)


def description_terms(plain: Column) -> Column:
    """Labels of the distinct terms a tag-free description names.

    A pattern is only tried where one of its anchor words stands in the text.
    """
    def named(x: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(_anchored(x["folded"], label) & F.regexp_like(x["plain"], _pattern(pattern)),
                   F.lit(label))
            for label, pattern in vocab.DESCRIPTION_TERMS]))

    return F.when(plain.isNotNull(), let(_both(plain), named)) \
        .otherwise(F.array().cast("array<string>"))


def _both(plain: Column) -> Column:
    return F.struct(plain.alias("plain"), _folded(plain).alias("folded"))


def description_mentions(plain: Column, terms: Column | None = None) -> Column:
    """How often a tag-free description names any of them, repeats included.

    Where the ``terms`` it names are known, only those are counted.
    """
    def count(text: Column, possible: Callable[[str], Column]) -> Column:
        return reduce(lambda a, b: a + b, [
            F.when(possible(label), F.regexp_count(text, _pattern(pattern))).otherwise(0)
            for label, pattern in vocab.DESCRIPTION_TERMS])

    if terms is not None:
        return count(plain, lambda label: F.array_contains(terms, label))
    return F.when(plain.isNotNull(), let(_both(plain), lambda x: count(
        x["plain"], lambda label: _anchored(x["folded"], label))))


def description_is_ai(plain: Column, terms: Column, cfg: Settings = DEFAULT) -> Column:
    """Enough distinct terms, or a few that run through the whole text.

    ``terms`` are those of ``description_terms`` for the same text.
    """
    few = (F.size(terms) >= 2) & (description_mentions(plain, terms) >= cfg.desc_min_mentions)
    return F.when(F.size(terms) >= cfg.desc_min_terms, True).otherwise(few)


def rules_version(cfg: Settings = DEFAULT) -> str:
    """Tells apart two sets of description rules: their terms and thresholds."""
    said = repr((sorted(vocab.DESCRIPTION_TERMS), cfg.desc_min_terms, cfg.desc_min_mentions,
                 cfg.desc_max_chars))
    return hashlib.sha256(said.encode()).hexdigest()
