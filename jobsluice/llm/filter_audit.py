"""Filter interaction audit: what each filter removes, in every order of the filters.

1. One pass over a text's bytes: tables give the class of each byte, the state
   after it (outside or inside a word) and what the step from state to state
   means. As the state after a byte hangs on that byte alone, whole blocks of
   bytes go through the tables at once; state and an open word are carried from
   block to block. The pass counts words, capitals, code points and symbols.
2. The spans of words go into a hash table that compares the bytes of words with
   equal hashes (a Python set of byte strings), so distinct words are exact.
3. A document becomes its set of failed filters, 32 sets in all. Everything that
   is asked about any order follows from the counts of these sets in each part.

Copies are found by SHA-256 of the text. A hot text or id is counted before it is
sent, and no task gathers the rows of a group.

Results in special cases: a null text is empty, a null lang the part ``''``. A
null id is no smaller and no greater than any other: such a row never fails E,
and no other fails by it. Rows that repeat id and text are copies of no smaller
id. Labels of an id that contradict each other count as each of what they say;
null labels as 0. Texts of any length are read block by block. An empty table
has no parts and gives no rows. Columns beside id, text and lang are left aside,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import store, whole_text

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# Classes of bytes, and the states of the pass.
SPACE, CAPITAL, SYMBOL, OTHER, TAIL = range(5)
CLASSES = 5
OUTSIDE, INSIDE = range(2)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[ord("A"):ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASS[0x80:0xC0] = TAIL             # a later byte of a code point
NEXT = np.array([[OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE]] * 2, dtype=np.uint8)
AFTER = NEXT[OUTSIDE]               # both rows are alike: the byte alone decides
# A step is state * CLASSES + class; what each step means.
OPENS = np.array([s == OUTSIDE and NEXT[s, c] == INSIDE for s in range(2) for c in range(CLASSES)])
CLOSES = np.array([s == INSIDE and NEXT[s, c] == OUTSIDE for s in range(2) for c in range(CLASSES)])
IS_CLASS = np.array([[c == k for s in range(2) for c in range(CLASSES)] for k in range(CLASSES)])


@dataclass(frozen=True)
class AuditSettings:
    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 3
    # Bytes that go through the tables at once.
    block: int = 1 << 20


def transduce(data: bytes, block: int = AuditSettings.block) -> tuple[int, int, int, int, int]:
    """Words, distinct words, capitals, code points and symbols of UTF-8 bytes."""
    steps = np.zeros(2 * CLASSES, dtype=np.int64)
    table: set[bytes] = set()
    state, open_at = OUTSIDE, []
    for at in range(0, len(data), block):
        kinds = CLASS[np.frombuffer(data, np.uint8, min(block, len(data) - at), at)]
        states = np.empty(len(kinds), np.uint8)
        states[0] = state
        states[1:] = AFTER[kinds[:-1]]
        state = int(NEXT[states[-1], kinds[-1]])
        taken = states * np.uint8(CLASSES) + kinds
        steps += np.bincount(taken, minlength=2 * CLASSES)
        starts = open_at + (np.flatnonzero(OPENS[taken]) + at).tolist()
        ends = (np.flatnonzero(CLOSES[taken]) + at).tolist()
        table.update([data[a:b] for a, b in zip(starts, ends)])
        open_at = starts[len(ends):]
    if open_at:
        table.add(data[open_at[0]:])
    count = IS_CLASS @ steps
    return (int(OPENS @ steps), len(table), int(count[CAPITAL]),
            int(steps.sum() - count[TAIL]), int(count[SYMBOL]))


COUNTS = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def _measured(cfg: AuditSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(2):
                data = text.as_py().encode("utf-8", "surrogatepass")
                counts.append(transduce(data, cfg.block))
                digests.append(hashlib.sha256(data).digest())
            columns = np.array(counts, dtype=np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, columns),
                 pa.array(digests, pa.binary())], names=["id", "part", *COUNTS, "digest"])
    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", cfg: AuditSettings = AuditSettings()) -> DataFrame:
    """``(id, part, COUNTS, digest)`` of every row."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"),
        whole_text(text_col).alias("text")).mapInArrow(
            _measured(cfg), f"id {kind}, part string, "
            + ", ".join(f"{c} long" for c in COUNTS) + ", digest binary")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(cfg: AuditSettings = AuditSettings()) -> Column:
    """The bits of the filters A to D, which look at one document alone."""
    fails = {
        "A": F.col("n_words") < cfg.min_words,
        "B": 100 * F.col("n_distinct") < cfg.min_distinct_percent * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > cfg.max_capital_percent * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }
    mask = F.lit(0)
    for letter, failed in fails.items():
        mask = mask + F.when(failed, _bit(letter)).otherwise(0)
    return mask


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang",
                   cfg: AuditSettings = AuditSettings()) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the set of filters they fail."""
    rows = store(measure(docs, id_col, text_col, lang_col, cfg).select(
        "id", "part", "digest", own_failures(cfg).alias("mask"))
        .groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without an id have no label; apart, they do not meet in one task of the join.
    no = F.lit(False)
    labelled = rows.where("id is not null").join(said, "id", "left").na.fill(
        False, ["good", "toxic"]).unionByName(
            rows.where("id is null").withColumn("good", no).withColumn("toxic", no))
    # Of each text, its parts and labels: all rows, and those of the smallest id.
    kinds = store(labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
        .alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")), "audit-texts")
    least = kinds.groupBy("digest").agg(F.min("least.id").alias("first"))
    sides = kinds.join(least, "digest").withColumn(
        "firsts", F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n"))
        .otherwise(0))
    split = F.inline(F.array(
        F.struct(F.col("mask"), F.col("firsts").alias("n")),
        F.struct((F.col("mask") + _bit("E")).alias("mask"),
                 (F.col("n") - F.col("firsts")).alias("n"))))
    return sides.select("part", "good", "toxic", split).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _steps() -> Column:
    """All 600 steps: the order, its step, that filter's bit and the bits before it."""
    rows = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            rows.append(F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"),
                                 F.lit(_bit(letter)).alias("bit"), F.lit(before).alias("before")))
            before |= _bit(letter)
    return F.array(*rows)


def over_orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step. ``counts`` has at most 32 rows a part."""
    met = counts.select("*", F.inline(_steps()))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    # Of all orders, those in which the filter comes before the others that a row fails.
    first = F.lit(factorial(len(FILTERS))) / F.bit_count(mask)

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")
    return met.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * first.cast("long")).otherwise(0)).cast("long")
        .alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", cfg: AuditSettings = AuditSettings()) -> DataFrame:
    counts = failure_counts(docs, labels, id_col, text_col, lang_col, cfg)
    return over_orders(store(counts, "audit-counts"))
