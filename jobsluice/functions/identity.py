"""Keys under which two postings are the same role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import hostname, let, path, strip, without_www

_CI = "(?iU)"


def normalize_company(company: Column) -> Column:
    """A company name without legal forms, generic words and punctuation."""
    words = "|".join(vocab.COMPANY_WORDS)
    text = F.replace(F.lower(F.coalesce(company, F.lit(""))), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, rf"{_CI}\b(?:{words})\b\.?", " ")
    key = F.regexp_replace(text, "[^a-z0-9]+", "")
    for name, short in vocab.COMPANY_ALIASES.items():
        key = F.when(key == name, short).otherwise(key)
    return key


def normalize_title(title: Column) -> Column:
    """A title as sorted tokens, without terms, ids, places and spelling variants."""
    text = F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("&"), F.lit(" and "))
    for pattern, token in vocab.TITLE_FOLDS:
        text = F.regexp_replace(text, _CI + pattern, token)
    text = F.regexp_replace(text, _CI + "|".join(vocab.TITLE_NOISE), " ")
    tokens = F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.array_sort(F.filter(tokens, lambda t: t != "")), " ")


def fingerprint(company: Column, title: Column) -> Column:
    return F.sha1(F.concat(normalize_company(company), F.lit("::"), normalize_title(title)))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def requisition_id(url: Column) -> Column:
    """The provider's own posting id read from its link, else empty."""
    def in_path(where: Column) -> Column:
        return F.coalesce(
            F.upper(F.replace(_found(where, vocab.REQ_WORKDAY), F.lit("-"), F.lit(""))),
            F.lower(_found(where, _CI + vocab.UUID, 0)),
            _found(where, vocab.REQ_PATH),
            F.lit(""))

    return let(F.coalesce(strip(url), F.lit("")), lambda link: F.coalesce(
        _found(link, vocab.REQ_GREENHOUSE), let(path(link), in_path)))


def fingerprint_key(printed: Column) -> Column:
    return F.concat(F.lit("fp:"), printed)


def role_key_struct(company: Column, title: Column, url: Column, key_fp: Column | None = None
                    ) -> Column:
    """``key_fp``, ``key_req`` and ``key_host``; the last two are null without an id.

    ``key_fp`` may be given where it is known. Id and host are made once a row.
    """
    def keys(said: Column) -> Column:
        req, host = said["req"], said["host"]
        return F.struct(
            said["fp"].alias("key_fp"),
            F.when(req != "", F.concat(
                F.lit("req:"), normalize_company(company), F.lit(":"), req)).alias("key_req"),
            F.when((req != "") & (host != ""), F.concat(
                F.lit("req@"), host, F.lit(":"), req)).alias("key_host"))

    fp = fingerprint_key(fingerprint(company, title)) if key_fp is None else key_fp
    return let(F.struct(fp.alias("fp"), requisition_id(url).alias("req"),
                        without_www(hostname(url)).alias("host")), keys)


def role_keys(company: Column, title: Column, url: Column) -> Column:
    return let(role_key_struct(company, title, url), lambda keys: F.array_compact(
        F.array(keys["key_fp"], keys["key_req"], keys["key_host"])))
