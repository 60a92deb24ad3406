"""Quality rules: a decision list learned by sequential covering.

Column functions compute a few counts of each text. On a bounded sample of
labelled documents a rule grows by the condition of largest information gain,
is pruned on rows it did not see, and what it covers is set aside; then the
next rule is learned. All statistics of a step come from one grouped count.
The list is emitted as one ordered conditional expression.

Results in special cases: a null text has no words and fails the base rule.
Null or contradicting labels are not learned from; with no usable label the
list is empty and only the base rule rejects. Each row is judged by its own
text, so repeated rows get the same verdict. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import WORD, bounded_sample, packed, store

SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks"]
FEATURES = ["symbols_per_word", "chars_per_word", "dup_line_share", "repeat_share",
            "upper_share", "marks_per_word", "n_words"]


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 50
    max_repeat_percent: int = 50
    # Rules are fitted on at most this many labelled documents.
    max_labels: int = 20_000
    thresholds: int = 40
    max_rules: int = 12
    max_conditions: int = 4
    # A rule must cover this many documents and be this sure, on rows it did not see.
    min_cover: int = 3
    min_precision: float = 0.97


def _kept_chars(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def with_counts(rows: DataFrame) -> DataFrame:
    """Add ``COUNTS`` of ``_text``. Each step is its own projection, so no array is built twice."""
    w, h, m, text = F.col("_w"), F.col("_h"), F.col("_m"), F.col("_text")
    size = F.size(w)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(size >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))) \
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twice = F.filter(h, lambda x, i: (
        ((i > 0) & (x["h"] == F.get(h, i - 1)["h"]))
        | ((i < F.size(h) - 1) & (x["h"] == F.get(h, i + 1)["h"]))))
    others = F.greatest(F.size(m) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(m, 2, others), F.slice(m, 1, others),
                      lambda a, b: F.least(a - b, F.lit(3)))
    covered = F.when(F.size(m) == 0, F.lit(0)).otherwise(
        F.lit(3) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
    keep = [c for c in rows.columns]
    return (
        rows.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
                    lines.alias("_lines"))
        .select(*keep, size.cast("long").alias("n_words"),
                _kept_chars(text, SPACES).alias("word_chars"),
                _kept_chars(text, r"[^#*$%&|<>]+").alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
                .alias("n_dup_lines"),
                F.size("_lines").cast("long").alias("n_lines"),
                _kept_chars(text, r"[^\p{Lu}]+").alias("n_upper"),
                _kept_chars(text, r"[^!?]+").alias("n_marks"),
                windows.alias("_h"))
        .select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_m"))
        .select("*", covered.cast("long").alias("n_repeat_words"))
        # Out of a generator, so that no filter on a count is pushed below and repeats its steps.
        .select(*keep, F.inline(F.array(F.struct(*COUNTS))))
    )


def base_failed(cfg: QualitySettings = QualitySettings()) -> Column:
    return (F.col("n_words") < cfg.min_words) | (
        100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words"))


def feature(name: str) -> Column:
    per_word = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / per_word,
        "chars_per_word": F.col("word_chars") / per_word,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / per_word,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / per_word,
        "n_words": F.col("n_words").cast("double"),
    }[name]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool             # bin >= cut, else bin < cut
    cut: int                # number of the threshold

    def on_bins(self) -> Column:
        value = F.element_at("bins", self.feature + 1)
        return value >= self.cut if self.above else value < self.cut


@dataclass(frozen=True)
class DecisionList:
    thresholds: list[list[float]] = field(default_factory=list)
    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The name of the first rule that holds, or ``keep``."""
        out = None
        for number, rule in enumerate(self.rules):
            holds = F.lit(True)
            for c in rule:
                cut = self.thresholds[c.feature][c.cut - 1]
                value = feature(FEATURES[c.feature])
                holds = holds & (value >= cut if c.above else value < cut)
            label = F.lit(f"rule_{number + 1}")
            out = F.when(holds, label) if out is None else out.when(holds, label)
        return F.lit("keep") if out is None else out.otherwise("keep")

    def describe(self) -> list[str]:
        return [" and ".join(
            f"{FEATURES[c.feature]} {'>=' if c.above else '<'} "
            f"{self.thresholds[c.feature][c.cut - 1]:.6g}" for c in rule) for rule in self.rules]


def labelled_sample(labels: DataFrame, cfg: QualitySettings) -> DataFrame:
    """``(id, bad)`` of at most ``max_labels`` documents, chosen by a hash of the id."""
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    return bounded_sample(clean, cfg.max_labels, "doc_id").select(
        F.col("doc_id").alias("_id"), (F.col("low") == 0).alias("bad"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          cfg: QualitySettings = QualitySettings()) -> DecisionList:
    # The sample's bound makes this broadcast safe.
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit(""))
                         .alias("_text")).join(F.broadcast(labelled_sample(labels, cfg)), "_id")
    values = store(with_counts(sample).where(~base_failed(cfg)).select(
        "bad", (F.pmod(F.xxhash64("_id", F.lit("grow")), F.lit(3)) > 0).alias("grow"),
        F.array(*[feature(f) for f in FEATURES]).alias("values")), "quality-labelled")
    return fit_rules(values, cfg)


def fit_rules(values: DataFrame, cfg: QualitySettings) -> DecisionList:
    """Sequential covering over ``(bad, grow, values)``."""
    steps = [i / cfg.thresholds for i in range(1, cfg.thresholds)]
    cuts = values.agg(*[F.percentile_approx(F.col("values")[i], steps, 20_000).alias(f"c{i}")
                        for i in range(len(FEATURES))]).first()
    bad_cuts = values.where("bad").agg(
        *[F.percentile_approx(F.col("values")[i], steps, 20_000).alias(f"c{i}")
          for i in range(len(FEATURES))]).first()
    if bad_cuts[0] is None:
        return DecisionList()
    thresholds = [sorted({*cuts[i], *bad_cuts[i]}) for i in range(len(FEATURES))]
    bins = [_bin(thresholds[i], F.col("values")[i]) for i in range(len(FEATURES))]
    rows = store(values.select("bad", "grow", F.array(*bins).alias("bins")), "quality-bins")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < cfg.max_rules:
        left = rows
        for done in rules:
            left = left.where(~_all(done))
        rule = _prune(left, _grow(left, cfg), cfg)
        if not rule:
            break
        rules.append(rule)
    return DecisionList(thresholds, rules)


def _bin(cuts: list[float], value: Column) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= value))


def _all(rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.on_bins()
    return out


def _grow(left: DataFrame, cfg: QualitySettings) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < cfg.max_conditions:
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        seen = left.where(F.col("grow") & _all(rule)).select(
            "bad", F.posexplode("bins").alias("f", "bin"))
        for f, b, p, n in seen.groupBy("f", "bin").agg(
                F.count_if("bad"), F.count_if(~F.col("bad"))).collect():
            counts.setdefault(f, {})[b] = (p, n)
        if not counts:
            break
        p_all = sum(p for p, _ in counts[0].values())
        n_all = sum(n for _, n in counts[0].values())
        if not p_all or not n_all:
            break
        best = (0.0, None)
        for f in sorted(counts):
            p_low = n_low = 0
            for b in range(0, max(counts[f]) + 1):
                if b and (p_low or n_low):
                    for above, p, n in ((True, p_all - p_low, n_all - n_low),
                                        (False, p_low, n_low)):
                        if p:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, above, b))
                p, n = counts[f].get(b, (0, 0))
                p_low, n_low = p_low + p, n_low + n
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(left: DataFrame, rule: list[Condition], cfg: QualitySettings):
    """The beginning of the rule that does best on rows it was not grown on."""
    if not rule:
        return None
    beginnings = [rule[:k] for k in range(1, len(rule) + 1)]
    counts = left.where(~F.col("grow")).agg(*[
        F.count_if(_all(part) & (F.col("bad") == is_bad)) for part in beginnings
        for is_bad in (True, False)]).first()
    best = None
    for k, part in enumerate(beginnings):
        p, n = counts[2 * k], counts[2 * k + 1]
        if p >= cfg.min_cover and p >= cfg.min_precision * (p + n):
            worth = ((p - n) / (p + n), p)
            if best is None or worth > best[0]:
                best = (worth, tuple(part))
    return best[1] if best else None


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text",
          cfg: QualitySettings = QualitySettings()) -> DataFrame:
    """``(_row, COUNTS, base_failed, verdict, kept)`` of every row."""
    counted = with_counts(packed(docs, text_col)).drop("_text")
    return counted.withColumn("base_failed", base_failed(cfg)) \
        .withColumn("verdict", F.when(F.col("base_failed"), "base").otherwise(rules.verdict())) \
        .withColumn("kept", F.col("verdict") == "keep")
