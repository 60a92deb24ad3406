"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

1. A text becomes features: the hash buckets of its distinct words (each of
   value ``1 / sqrt(their number)``), one bin for each structure statistic, and one
   for each piece of metadata (characters and bytes of the record). Lang, source,
   id and labels are no features.
2. A second-order machine is fitted by Spark ML to a bounded sample of labelled
   documents. Each feature has a weight and a short vector; two features act
   together by the product of their vectors.
3. Scores take the sum-of-squares identity: the sum over all pairs of
   ``<v_i, v_j> x_i x_j`` is half of ``(sum v_i x_i)^2 - sum (v_i x_i)^2``, so the time
   is linear in the features. One pass over the texts, nothing is shuffled.

Results in special cases: a null text counts as empty; an empty one is scored by
its levels. Labels that are null, that contradict each other or that belong to no
document are not learned from. With labels of one kind only, or none, every score
is the smoothed share of the label 1. Repeated rows are scored alike. A very long
text is read part by part, and its features are bounded by the buckets. An empty
table gives no rows. Columns beside id and text are left aside, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import bounded_sample, store, whole_text, word_chunks
from jobsluice.llm.quality import QualitySettings, labelled_sample


@dataclass(frozen=True)
class FactorSettings:
    buckets: int = 1 << 12
    factors: int = 6
    # The machine is fitted on at most this many labelled documents.
    max_labels: int = 12_000
    iterations: int = 60
    step: float = 0.02
    regularisation: float = 0.01
    seed: int = 7
    threshold: float = 0.3


_SYMBOLS, _MARKS, _DIGITS = b"#*$%&|<>", b"!?", b"0123456789"
_UPPER, _STOPS = bytes(range(65, 91)), b".,;:"
_SHARES = [0.0, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.8]
# Statistics and their levels, the last two from the record's size.
LEVELS: dict[str, list[float]] = {
    "words": [1, 3, 8, 20, 50, 100, 200, 500, 1000, 3000, 10_000],
    "word_bytes": [2, 3, 4, 5, 6, 7, 8, 10, 15],
    "distinct_share": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99],
    "symbols_a_word": _SHARES, "marks_a_word": _SHARES, "digits_a_byte": _SHARES,
    "capitals_a_byte": _SHARES, "stops_a_word": _SHARES,
    "lines": [1, 2, 4, 8, 16, 32, 64, 128],
    "repeated_lines": [0.001, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "chars": [2.0 ** k for k in range(4, 20)],
    "bytes_a_char": [1.001, 1.02, 1.05, 1.1, 1.3, 2.0],
}
_EDGES = [np.array(edges) for edges in LEVELS.values()]
_FIRST = np.concatenate([[0], np.cumsum([len(e) for e in _EDGES])])
MARKS = int(_FIRST[-1])


def _among(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def features(text: str, cfg: FactorSettings = FactorSettings()) -> tuple[list[int], list[int]]:
    """Word buckets of a text, and the levels that its statistics reach."""
    data = text.encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    words = size = 0
    for part in word_chunks(data):
        seen.update(part)
        words += len(part)
        size += sum(map(len, part))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    per_word, per_byte = max(words, 1), max(len(data), 1)
    values = (
        words, size / per_word, len(seen) / per_word, _among(data, _SYMBOLS) / per_word,
        _among(data, _MARKS) / per_word, _among(data, _DIGITS) / per_byte,
        _among(data, _UPPER) / per_byte, _among(data, _STOPS) / per_word, len(lines),
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(text),
        len(data) / max(len(text), 1))
    levels = [at for f, e, v in zip(_FIRST, _EDGES, values)
            for at in range(int(f), int(f + np.searchsorted(e, v, side="right")))]
    return sorted({zlib.crc32(w) % cfg.buckets for w in seen}), levels


def _featured(cfg: FactorSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), cfg) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([[str(b) for b in m[0]] for m in made], pa.list_(pa.string())),
                 pa.array([[str(b) for b in m[1]] for m in made], pa.list_(pa.string()))],
                names=["label", "mark", "words", "levels"])
    return run


@dataclass(frozen=True)
class FactorModel:
    bias: float
    weights: np.ndarray         # of each feature: buckets first, then levels
    vectors: np.ndarray         # feature by factor

    def score(self, words: list[int], levels: list[int], cfg: FactorSettings) -> float:
        at = np.array(words + [cfg.buckets + b for b in levels], dtype=np.int64)
        x = np.ones(len(at))
        x[:len(words)] = len(words) ** -0.5 if words else 0.0
        terms = self.vectors[at] * x[:, None]
        pairs = 0.5 * float((terms.sum(axis=0) ** 2 - (terms ** 2).sum(axis=0)).sum())
        margin = self.bias + float(self.weights[at] @ x) + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0))))


def _vectors(cfg: FactorSettings) -> Pipeline:
    """Feature vectors in Spark ML, laid out like ``FactorModel``."""
    def counted(size: int, given: str, out: str) -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(
            [str(k) for k in range(size)], given, out).setBinary(True).setMinTF(0.0)
    return Pipeline(stages=[
        counted(cfg.buckets, "words", "bags"),
        Normalizer(inputCol="bags", outputCol="shares", p=2.0),
        counted(MARKS, "levels", "marks"),
        VectorAssembler(inputCols=["shares", "marks"], outputCol="features")])


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", cfg: FactorSettings = FactorSettings()) -> DataFrame:
    """``(label, mark, words, levels)`` of a bounded sample of the labelled documents."""
    sample = labelled_sample(labels, QualitySettings(max_labels=cfg.max_labels))
    # The sample's bound makes this broadcast safe.
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).join(
        F.broadcast(sample), "_id").select(
            F.when(F.col("bad"), 0.0).otherwise(1.0).alias("label"),
            F.xxhash64("_id", "text").alias("mark"), "text")
    made = store(rows.mapInArrow(
        _featured(cfg), "label double, mark long, words array<string>, levels array<string>"),
        "factor-features")
    # Ids that repeat bring more rows than labels.
    return bounded_sample(made, cfg.max_labels, "mark")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          cfg: FactorSettings = FactorSettings()) -> FactorModel:
    rows = labelled_features(docs, labels, id_col, text_col, cfg)
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good == 0 or good == n:
        share = (good + 1) / (n + 2)
        size = cfg.buckets + MARKS
        return FactorModel(float(np.log(share / (1 - share))), np.zeros(size),
                           np.zeros((size, cfg.factors)))
    # The rarer label's rows repeat until both labels weigh about the same.
    often = F.when(F.col("label") == 1.0, max(1, round((n - good) / good))).otherwise(
        max(1, round(good / (n - good))))
    even = rows.withColumn("_", F.explode(F.sequence(F.lit(1), often.cast("int"))))
    made = _vectors(cfg).fit(even).transform(even).select("label", "features")
    fitted = FMClassifier(
        factorSize=cfg.factors, maxIter=cfg.iterations, stepSize=cfg.step, seed=cfg.seed,
        regParam=cfg.regularisation, solver="adamW").fit(made)
    return FactorModel(float(fitted.intercept), fitted.linear.toArray(),
                       fitted.factors.toArray())


def _scored(model: FactorModel, cfg: FactorSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(*features(t.as_py(), cfg), cfg) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])
    return run


def score(docs: DataFrame, model: FactorModel, id_col: str = "doc_id", text_col: str = "text",
          cfg: FactorSettings = FactorSettings()) -> DataFrame:
    """``(id, score)`` of every row."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(
        _scored(model, cfg), f"id {kind}, score double")


def predicted(cfg: FactorSettings = FactorSettings()) -> Column:
    return (F.col("score") >= cfg.threshold).cast("int")
