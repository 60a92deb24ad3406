"""Source divergence audit: how far the word use of each source lies from the others'.

1. Tasks count the terms of their documents per (lang, source) and send counts,
   never single words. A lang keeps the terms that stand in enough of its
   documents; with a pseudo-count each group gives each kept term a share, a
   whole number of billionths. All arithmetic is on whole numbers.
2. The groups of a lang and its kept terms are dealt into blocks by hashes. A
   slice holds the shares of one group block in one term block.
3. The work is a cube: a cell (group block, group block, term block) is owned by
   one task. Each slice is copied to the cells of its row and of its column; a
   cell sums the differences of its pairs of groups over its terms.
4. The partial sums are added up along the term axis.

Copies and cells are bounded by the block sizes, whatever group or term is hot.

Results in special cases: null text, lang and source count as empty. Every
occurring (lang, source) is a group, also without a term; with no kept term its
distances are 0. A lang with one source has no pairs. Repeated rows are
documents of their own. Ties are ordered by the item's UTF-8 bytes. A very long
text is counted part by part. An empty table gives no rows. All columns beside
text, lang and source are left aside, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.llm.common import store, whole_text, word_chunks

# Bytes outside terms become spaces, A to Z become small; all others stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class DivergenceSettings:
    min_docs: int = 30
    pseudo_count: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    # A cell compares two blocks of about so many groups over about so many terms.
    group_block: int = 32
    term_block: int = 4_096
    # Counts that a task holds before it sends them on.
    held_terms: int = 400_000


def folded(text: str) -> bytes:
    """The text with spaces for all that is no part of a term; A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def _sent(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        found = list(counts)
        for at in range(0, len(found), 50_000):
            part = found[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()),
                 pa.array([source] * len(part), pa.string()),
                 pa.array(part, pa.binary()).cast(pa.string()),
                 pa.array([counts[t] for t in part], pa.int64()),
                 pa.array([docs[t] for t in part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])


def _count(cfg: DivergenceSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                counts, docs = held.setdefault((lang.as_py(), source.as_py()),
                                               (Counter(), Counter()))
                before, seen = len(counts), set()
                for words in word_chunks(folded(text.as_py())):
                    counts.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(counts) - before
                if size > cfg.held_terms:
                    yield from _sent(held)
                    held, size = {}, 0
        yield from _sent(held)
    return run


def _share(count: str, total: str, cfg: DivergenceSettings) -> Column:
    """``1 + floor(scale * (count + pseudo) / (total + pseudo * n_terms))``, in whole numbers."""
    extra = cfg.pseudo_count
    return F.expr(f"1 + (cast({cfg.scale} as decimal(18, 0)) * cast({count} + {extra} as "
                  f"decimal(19, 0))) div cast({total} + {extra} * n_terms as decimal(19, 0))")


def _numbered(rows: DataFrame, key: str, size: int, count: str, block: str,
              place: str) -> DataFrame:
    """``block`` by a hash of ``key`` in blocks of about ``size``, and ``place`` in it."""
    blocks = F.ceil(F.col(count) / size).cast("int")
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(key), blocks).cast("int"))
    inside = Window.partitionBy("lang", block).orderBy(key)
    return dealt.withColumn(place, F.row_number().over(inside) - 1)


@dataclass(frozen=True)
class Profiles:
    langs: DataFrame        # lang, n_groups, n_terms, lang_total, term_blocks
    groups: DataFrame       # lang, source, group_block, group_at, base and the lang's columns
    terms: DataFrame        # lang, term, lang_count, term_block, term_at
    shares: DataFrame       # lang, source, term of a count above 0, with share and lang_share


def profiles(docs: DataFrame, cfg: DivergenceSettings = DivergenceSettings()) -> Profiles:
    """Kept terms, groups and shares; written once, as the steps after read them often."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = store(
        docs.select(*named, whole_text().alias("text")).mapInArrow(
            _count(cfg), "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts")
    kept = store(counts.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_count"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= cfg.min_docs).select("lang", "term", "lang_count"),
        "divergence-kept")
    pairs = docs.select(*named).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"),
                                     F.sum("lang_count").alias("lang_total"))
    langs = store(pairs.groupBy("lang").agg(F.count("*").alias("n_groups")).join(
        sizes, "lang", "left").na.fill(0, ["n_terms", "lang_total"]), "divergence-langs")
    terms = store(_numbered(kept.join(langs, "lang"), "term", cfg.term_block, "n_terms",
                            "term_block", "term_at").drop("n_groups"), "divergence-terms")
    used = store(counts.drop("docs").join(terms, ["lang", "term"]), "divergence-used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = _numbered(pairs.join(langs, "lang"), "source", cfg.group_block, "n_groups",
                         "group_block", "group_at")
    groups = store(
        numbered.join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
        .withColumn("none", F.lit(0)).withColumn(
            "base", F.when(F.col("n_terms") > 0, _share("none", "total", cfg)).otherwise(0))
        .drop("none"), "divergence-groups")
    shares = store(
        used.join(groups.select("lang", "source", "group_block", "group_at", "total"),
                  ["lang", "source"])
        .withColumn("share", _share("n", "total", cfg))
        .withColumn("lang_share", _share("lang_count", "lang_total", cfg)), "divergence-shares")
    return Profiles(langs, groups, terms, shares)


def slices(found: Profiles, cfg: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """One row for each group block and term block, also where no term is used."""
    blocks = found.groups.groupBy("lang", "group_block").agg(
        F.sort_array(F.collect_list(F.struct("group_at", "base", "source"))).alias("groups"),
        F.first("n_groups").alias("n_groups"), F.first("n_terms").alias("n_terms"))
    last = F.greatest(F.ceil(F.col("n_terms") / cfg.term_block).cast("int") - 1, F.lit(0))
    grid = blocks.withColumn("term_block", F.explode(F.sequence(F.lit(0), last)))
    widths = found.terms.groupBy("lang", "term_block").agg(F.count("*").alias("width"))
    filled = found.shares.groupBy("lang", "group_block", "term_block").agg(
        F.collect_list(F.struct("group_at", "term_at", "share")).alias("cells"))
    return grid.join(widths, ["lang", "term_block"], "left").join(
        filled, ["lang", "group_block", "term_block"], "left").select(
            "lang", "group_block", "term_block", "n_groups",
            F.coalesce("width", F.lit(0)).alias("width"),
            F.col("groups.base").alias("base"), F.col("groups.source").alias("source"),
            *[F.coalesce(F.col(f"cells.{c}"), F.array().cast(f"array<{kind}>")).alias(c)
              for c, kind in (("group_at", "int"), ("term_at", "int"), ("share", "bigint"))])


def _matrix(part) -> np.ndarray:
    """Shares of the slice's groups (rows) in the terms of its block (columns)."""
    dense = np.repeat(np.asarray(part.base, np.int64)[:, None], int(part.width), axis=1)
    dense[np.asarray(part.group_at, np.int64), np.asarray(part.term_at, np.int64)] = \
        np.asarray(part.share, np.int64)
    return dense


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Differences of the pairs of a cell, each pair once."""
    parts = sorted(rows.itertuples(), key=lambda r: r.group_block)
    left, right = parts[0], parts[-1]
    one = _matrix(left)
    other = one if left is right else _matrix(right)
    out = []
    for at, source in enumerate(left.source):
        first = at + 1 if left is right else 0
        sums = np.abs(other[first:] - one[at]).sum(axis=1)
        out += [(left.lang, source, item, int(v)) for item, v in zip(right.source[first:], sums)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def pair_distances(found: Profiles, cfg: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """``(lang, source, item, value)``: each two sources of a lang, both ways round."""
    made = store(slices(found, cfg), "divergence-slices")
    last = F.ceil(F.col("n_groups") / cfg.group_block).cast("int") - 1
    own = F.col("group_block")
    copies = made.withColumn("with", F.explode(F.sequence(F.lit(0), last))).select(
        "*", F.least(own, "with").alias("row_block"),
        F.greatest(own, "with").alias("column_block")).drop("with", "n_groups")
    partial = copies.groupBy("lang", "row_block", "column_block", "term_block").applyInPandas(
        _cell, "lang string, source string, item string, value long")
    total = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"),
                            F.struct(F.col("item").alias("source"),
                                     F.col("source").alias("item"))))
    return total.select("lang", "value", both).select("lang", "source", "item", "value")


def term_differences(found: Profiles) -> DataFrame:
    """``(lang, source, item, value)``: terms of a source that its lang uses less."""
    return found.shares.where("share > lang_share").select(
        "lang", "source", F.col("term").alias("item"),
        (F.col("share") - F.col("lang_share")).alias("value"))


def audit(docs: DataFrame, cfg: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """``(lang, source, part, item, value, rank)``."""
    found = profiles(docs, cfg)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
              for part, rows in (("pair", pair_distances(found, cfg)),
                                 ("term", term_differences(found)))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= cfg.top_terms)).select(
        "lang", "source", "part", "item", "value", "rank")
