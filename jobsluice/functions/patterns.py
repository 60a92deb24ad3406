"""How the fixed vocabularies are put together into patterns."""

from __future__ import annotations

from collections.abc import Iterable

from jobsluice.functions import vocab


def any_of(terms: Iterable[str]) -> str:
    """One case-insensitive, Unicode-aware alternation, for yes/no matching.

    Terms that open a word share one boundary test, so most positions of a
    text are passed over without trying any of them.
    """
    terms = list(terms)
    words = [t.removeprefix(r"\b") for t in terms if t.startswith(r"\b")]
    rest = [t for t in terms if not t.startswith(r"\b")]
    opening = [rf"\b(?:{'|'.join(words)})"] if words else []
    return "(?iU)" + "|".join(opening + rest)


def towns(names: list[str], guard: str) -> list[str]:
    """Town names that are neither streets nor places of that name elsewhere."""
    return [name + vocab.NOT_A_STREET + guard for name in names]


def ontario_terms() -> list[str]:
    return (vocab.ONTARIO_PLAIN
            + towns(vocab.SHARED_TOWNS + vocab.SHARED_GTA_TOWNS, vocab.NOT_ELSEWHERE)
            + towns(vocab.CALIFORNIA_TOWNS, vocab.NOT_ELSEWHERE_NOR_CA))


def commute_terms() -> list[str]:
    return (vocab.COMMUTE_PLAIN
            + towns(vocab.COMMUTE_SHARED_TOWNS + vocab.SHARED_GTA_TOWNS, vocab.NOT_ELSEWHERE)
            + towns(vocab.CALIFORNIA_TOWNS, vocab.NOT_ELSEWHERE_NOR_CA))


def far_terms() -> list[str]:
    return vocab.FAR_PLAIN + towns(vocab.FAR_SHARED_TOWNS, vocab.NOT_ELSEWHERE)
