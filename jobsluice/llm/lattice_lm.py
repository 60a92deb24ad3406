"""Subword lattice likelihood of whole texts.

The pieces are those of an existing subword vocabulary, and its scores are the
prior of their weights; expected counts over the training corpus move the
weights. A text's probability is the sum over all ways to segment it, got by a
forward recursion in log space. A piece never crosses white space, so the sum
over a whole text is the product of the sums over its words, each begun by the
word mark, and of the end token; a word is solved once however often it occurs.

1. Count every word of every text (training and all), combined per task.
2. Each distinct word's arcs, the pieces that fit at each of its places, are
   found once and stored.
3. Expectation steps: forward and backward over distinct training words, each
   weighted by its count; counts of pieces meet in one small aggregate. Every
   step reads all of them, whatever their number. Arcs of a batch of words that
   begin and end at equal places are taken together.
4. The forward recursion gives each distinct word its log probability.
5. Texts look their words up: frequent ones in a table of bounded size that
   travels with the task, the others by a join on the word.

Results in special cases: a null or empty text is the end token alone. A
character outside the vocabulary is spelled in byte pieces. A word of over 40
characters is summed by itself in log space, however long. Repeated rows are
scored, and counted, each for itself. Rows with a null id count as training.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import store, tasks, whole_text

MARK = "▁"
LOG10 = math.log(10.0)


@dataclass(frozen=True)
class LatticeSettings:
    vocabulary: str = "piece_bpe_32k.model"
    # The most frequent words travel with every task; the others are joined.
    head_words: int = 120_000
    # Weight of the vocabulary's own scores, as a number of training pieces.
    prior: float = 100.0
    # Expectation steps, each over all distinct training words.
    steps: int = 5
    prior_shift: float = 20.0
    held_words: int = 400_000


@dataclass(frozen=True)
class Pieces:
    """Piece ids, byte pieces first; ``prior`` are probabilities from the vocabulary's scores."""
    ids: dict[str, int]
    prior: np.ndarray

    @staticmethod
    def load(cfg: LatticeSettings) -> Pieces:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(cfg.vocabulary))
        ids, scores = {}, [0.0] * 256
        for k in range(model.get_piece_size()):
            if model.is_byte(k) or model.is_control(k) or model.is_unknown(k):
                continue
            piece = model.id_to_piece(k).encode().lower().decode()
            if piece not in ids:
                ids[piece] = len(scores)
                scores.append(0.0)
            # The scores fall by one a rank; weights fall as one over the rank.
            scores[ids[piece]] += 1.0 / (cfg.prior_shift - model.get_score(k))
        low = min(s for s in scores if s > 0)
        weights = np.array([s or low for s in scores])
        return Pieces(ids, weights / weights.sum())

    def trie(self) -> dict:
        root: dict = {}
        for piece, at in self.ids.items():
            node = root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = at
        return root


def arcs_of(text: str, trie: dict) -> list[list[tuple[int, list[int]]]]:
    """For each place, the pieces that begin there: ``(end, piece ids)``."""
    out = []
    for start in range(len(text)):
        node, at, found, single = trie, start, [], False
        while at < len(text):
            node = node.get(text[at])
            if node is None:
                break
            at += 1
            piece = node.get("")
            if piece is not None:
                found.append((at, [piece]))
                single = single or at == start + 1
        if not single:
            found.append((start + 1, list(text[start].encode("utf-8", "surrogatepass"))))
        out.append(found)
    return out


def log_sum(values: list[float]) -> float:
    top = max(values)
    if len(values) == 1 or top == -math.inf:
        return top
    return top + math.log(math.fsum(math.exp(v - top) for v in values))


def forward(text: str, trie: dict, weight: list[float]) -> float:
    """Log of the sum over all segmentations of ``text``."""
    into: list[list[float]] = [[] for _ in range(len(text) + 1)]
    into[0].append(0.0)
    exp, log = math.exp, math.log
    for start in range(len(text)):
        reached = into[start]
        if not reached:
            continue
        if len(reached) == 1:
            so_far = reached[0]
        else:
            top = max(reached)
            total = 0.0
            for v in reached:
                total += exp(v - top)
            so_far = top + log(total)
        into[start] = []
        node, at, single = trie, start, False
        while at < len(text):
            node = node.get(text[at])
            if node is None:
                break
            at += 1
            piece = node.get("")
            if piece is not None:
                into[at].append(so_far + weight[piece])
                single = single or at == start + 1
        if not single:
            spelled = so_far
            for byte in text[start].encode("utf-8", "surrogatepass"):
                spelled += weight[byte]
            into[start + 1].append(spelled)
    return log_sum(into[-1])


# Products of piece weights of a word no longer than this seldom leave a float's range.
SHORT = 40
# Words whose probability is below this are summed in log space.
LEAST = 1e-290


def compile_arcs(text: str, trie: dict, where: list[int], piece: list[int]) -> None:
    """Append the arcs of a short word: ``start * 64 + length`` and the piece of each.

    A character that no piece spells is ``-1 - code point``.
    """
    size = len(text)
    for start in range(size):
        node, at, single = trie, start, False
        while at < size:
            node = node.get(text[at])
            if node is None:
                break
            at += 1
            found = node.get("")
            if found is not None:
                where.append(start << 6 | at - start)
                piece.append(found)
                if at == start + 1:
                    single = True
        if not single:
            where.append(start << 6 | 1)
            piece.append(-1 - ord(text[start]))


class Lattice:
    """The arcs of many short words, in groups of equal start and length.

    A word has at most one arc in a group, so a group is one array operation;
    groups in order of their start reach every place before it is left.
    ``sizes`` are the words' numbers of arcs, each at least one.
    """

    def __init__(self, where: np.ndarray, piece: np.ndarray, sizes: np.ndarray, pieces: int):
        begins = np.cumsum(sizes) - sizes
        start, span = where >> 6, where & 63
        length = np.maximum.reduceat(start + span, begins)
        self.last = np.cumsum(length + 1) - 1
        self.first = self.last - length
        order = np.argsort(where.astype(np.int16), kind="stable")
        self.begin = (np.repeat(self.first, sizes) + start)[order]
        self.end = self.begin + span[order]
        grouped = where[order]
        edges = np.flatnonzero(np.diff(grouped)) + 1
        self.groups = [slice(a, b) for a, b in zip([0, *edges], [*edges, len(grouped)])]
        self.piece, self.pieces = piece[order].astype(np.int64), pieces
        odd = self.piece < 0
        codes, at = np.unique(self.piece[odd], return_inverse=True)
        self.spelled = [list(chr(-1 - c).encode("utf-8", "surrogatepass"))
                        for c in codes.tolist()]
        self.piece[odd] = pieces + at

    def _shares(self, share: np.ndarray) -> np.ndarray:
        odd = [math.prod(share[b] for b in spelled) for spelled in self.spelled]
        return np.concatenate([share, np.array(odd, dtype=float)])[self.piece]

    def _ahead(self, p: np.ndarray) -> np.ndarray:
        ahead = np.zeros(self.last[-1] + 1)
        ahead[self.first] = 1.0
        for g in self.groups:
            ahead[self.end[g]] += ahead[self.begin[g]] * p[g]
        return ahead

    def totals(self, share: np.ndarray) -> np.ndarray:
        """Each word's probability."""
        return self._ahead(self._shares(share))[self.last]

    def expect(self, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece in all words, and the places of words left out as too rare."""
        p = self._shares(share)
        ahead = self._ahead(p)
        total = ahead[self.last]
        lost = ~(total > LEAST)
        back = np.zeros(len(ahead))
        back[self.last] = np.where(lost, 0.0, counts / np.where(lost, 1.0, total))
        for g in reversed(self.groups):
            back[self.begin[g]] += back[self.end[g]] * p[g]
        uses = np.bincount(self.piece, ahead[self.begin] * p * back[self.end],
                           self.pieces + len(self.spelled))
        for spelled, n in zip(self.spelled, uses[self.pieces:]):
            for byte in spelled:
                uses[byte] += n
        return uses[:self.pieces], np.flatnonzero(lost)


def expect_long(text: str, count: float, trie: dict, weight: list[float],
                into: list[float]) -> None:
    """Add the expected uses of each piece in ``count`` occurrences of a word, in log space."""
    size = len(text)
    costs = [[(end, ids, sum(weight[i] for i in ids)) for end, ids in found]
             for found in arcs_of(text, trie)]
    incoming: list[list[float]] = [[] for _ in range(size + 1)]
    incoming[0].append(0.0)
    ahead = []
    for start in range(size):
        value = log_sum(incoming[start])
        ahead.append(value)
        for end, _, cost in costs[start]:
            incoming[end].append(value + cost)
    total = log_sum(incoming[size])
    back = [0.0] * (size + 1)
    for start in range(size - 1, -1, -1):
        back[start] = log_sum([cost + back[end] for end, _, cost in costs[start]])
        for end, ids, cost in costs[start]:
            uses = count * math.exp(ahead[start] + cost + back[end] - total)
            for piece in ids:
                into[piece] += uses


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count_words(cfg: LatticeSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def out():
            words = list(train.keys() | other.keys())
            return pa.RecordBatch.from_arrays([
                pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()),
                pa.array([train[w] for w in words], pa.int64()),
                pa.array([train[w] + other[w] for w in words], pa.int64())],
                names=["word", "train", "all"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (other if held else train).update(lower_words(text.as_py()))
                if len(train) + len(other) > cfg.held_words:
                    yield out()
                    train.clear()
                    other.clear()
        if train or other:
            yield out()
    return run


def _compile_words(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pieces.trie()
        for batch in batches:
            where, piece, offsets = [], [], [0]
            for word in batch.column(0).to_pylist():
                if len(word) < SHORT:
                    compile_arcs(MARK + word, trie, where, piece)
                offsets.append(len(where))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.ListArray.from_arrays(offsets, pa.array(where, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(piece, pa.int32()))],
                names=["word", "train", "all", "arc", "piece"])
    return run


def _lattice(batch: pa.RecordBatch, pieces: int) -> tuple[np.ndarray, Lattice | None]:
    """Which rows of ``(word, train, all, arc, piece)`` are short words, and their arcs."""
    sizes = np.diff(batch.column(3).offsets.to_numpy())
    short = np.flatnonzero(sizes)
    if not len(short):
        return short, None
    where, piece = (batch.column(k).flatten().to_numpy() for k in (3, 4))
    return short, Lattice(where, piece, sizes[short], pieces)


def _expected(pieces: Pieces, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, log_weight, share = pieces.trie(), weight.tolist(), np.exp(weight)
        uses, alone = np.zeros(len(weight)), [0.0] * len(weight)
        for batch in batches:
            words, counts = batch.column(0), batch.column(1).to_numpy()
            short, lattice = _lattice(batch, len(weight))
            left = np.setdiff1d(np.arange(len(words)), short)
            if lattice:
                found, lost = lattice.expect(counts[short].astype(float), share)
                uses += found
                left = np.concatenate([left, short[lost]])
            for k in left.tolist():
                expect_long(MARK + words[k].as_py(), float(counts[k]), trie, log_weight, alone)
        uses += np.array(alone)
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(uses[at])], names=["piece", "uses"])
    return run


def _solve_words(pieces: Pieces, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, log_weight, share = pieces.trie(), weight.tolist(), np.exp(weight)
        for batch in batches:
            short, lattice = _lattice(batch, len(weight))
            total = np.zeros(batch.num_rows)
            if lattice:
                total[short] = lattice.totals(share)
            kept = total > LEAST
            solved = np.log10(np.where(kept, total, 1.0))
            for k in np.flatnonzero(~kept).tolist():
                solved[k] = forward(
                    MARK + batch.column(0)[k].as_py(), trie, log_weight) / LOG10
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(solved)],
                names=["word", "train", "all", "lattice"])
    return run


def _score(head):
    """A row of sums for each text, and a row for each of its words that is not in the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, none_found = head.value["place"].get, repeat(-1)
        known, base, lattice = (head.value[c] for c in ("known", "base", "lattice"))
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            kind = batch.schema.field(0).type
            sums, tails = [], []
            for doc, held, text in zip(batch.column(0), batch.column(1).to_pylist(),
                                       batch.column(2)):
                words = lower_words(text.as_py())
                rows = np.fromiter(map(place, words, none_found), np.int64, len(words))
                found = rows[rows >= 0]
                rest = Counter([words[k] for k in np.flatnonzero(rows < 0).tolist()])
                sums.append((at, doc.as_py(), held, len(words) + 1, int(known[found].sum()),
                             float(base[found].sum()), float(lattice[found].sum())))
                tails.extend((at, w.decode("utf-8", "surrogatepass"), n)
                             for w, n in rest.items())
                at += 1
            for rows, tail in ((sums, False), (tails, True)):
                for start in range(0, len(rows), 20_000):
                    part = list(zip(*rows[start:start + 20_000]))
                    size = len(part[0])
                    none = [None] * size
                    columns = [part[0], none, none, none, none, none, none, part[1], part[2]] \
                        if tail else [*part, none, none]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, [
                            pa.int64(), kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                            pa.float64(), pa.string(), pa.int64()])],
                        names=["rid", "id", "held_out", "n_tokens", "known", "base", "lattice",
                               "word", "tf"])
    return run


def most_frequent(words: DataFrame, count: str, most: int) -> DataFrame:
    """The words above the lowest count that no more than ``most`` of them reach.

    The bound is read off a histogram over the count's logarithm: a few hundred
    rows whatever the data, and nothing is sorted.
    """
    step = F.floor(F.log2(count) * 16).alias("step")
    steps = words.where(F.col(count) > 0).groupBy(step).agg(
        F.count("*").alias("n"), F.min(count).alias("least")).orderBy(F.desc("step")).collect()
    seen, least = 0, None
    for row in steps:
        seen += row["n"]
        if seen > most:
            break
        least = row["least"]
    return words.where(F.lit(False) if least is None else F.col(count) >= least)


@dataclass(frozen=True)
class LatticeModel:
    words: DataFrame        # word, train, all, lattice (log10)
    train_tokens: int
    train_distinct: int
    train_docs: int
    end: float              # log10 of the end piece
    pieces: Pieces
    weight: np.ndarray      # natural logs


def train(docs: DataFrame, held_out, text_col: str = "text",
          cfg: LatticeSettings = LatticeSettings()) -> LatticeModel:
    """Count all words, move the piece weights by the training ones, solve every word."""
    text = whole_text(text_col).alias("text")
    parts = docs.select(held_out.alias("held"), text).mapInArrow(
        _count_words(cfg), "word string, train long, all long")
    words = store(parts.groupBy("word").agg(
        F.sum("train").alias("train"), F.sum("all").alias("all")), "lattice-words")
    # A hash deals long words evenly over the tasks.
    words = words.repartition(tasks(docs.sparkSession), "word")
    totals = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    train_docs = docs.where(~held_out).count()
    pieces = Pieces.load(cfg)
    compiled = store(words.mapInArrow(
        _compile_words(pieces),
        "word string, train long, all long, arc array<int>, piece array<int>"), "lattice-arcs")
    known = compiled.where("train > 0")
    weight = np.log(pieces.prior)
    for _ in range(cfg.steps):
        uses = known.mapInArrow(_expected(pieces, weight), "piece int, uses double") \
            .groupBy("piece").agg(F.sum("uses")).collect()
        counts = cfg.prior * pieces.prior
        for piece, n in uses:
            counts[piece] += n
        total = counts.sum() + train_docs + 1
        weight = np.log(counts / total)
    solved = store(compiled.mapInArrow(
        _solve_words(pieces, weight), "word string, train long, all long, lattice double"),
        "lattice-solved")
    return LatticeModel(solved, totals[0] + train_docs, totals[1] + (train_docs > 0), train_docs,
                        math.log10((train_docs + 1) / total), pieces, weight)


def score(docs: DataFrame, model: LatticeModel, held_out, id_col: str = "doc_id",
          text_col: str = "text", cfg: LatticeSettings = LatticeSettings()) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    spark = docs.sparkSession
    scale = math.log10(model.train_tokens + 0.5 * (model.train_distinct + 1))

    def base(count):
        return F.log10(F.col(count) + 0.5) - F.lit(scale)

    valued = model.words.select("word", F.when(F.col("train") > 0, 1).otherwise(0)
                                .cast("long").alias("w_known"), base("train").alias("w_base"),
                                F.col("lattice").alias("w_lattice"), "all")
    # At most ``head_words`` rows come to the driver.
    top = most_frequent(valued, "all", cfg.head_words).drop("all").toPandas()
    head = spark.sparkContext.broadcast({
        "place": {w.encode("utf-8", "surrogatepass"): k for k, w in enumerate(top["word"])},
        "known": top["w_known"].to_numpy(), "base": top["w_base"].to_numpy(),
        "lattice": top["w_lattice"].to_numpy()})
    del top
    kind = dict(docs.dtypes)[id_col]
    parts = store(docs.select(F.col(id_col).alias("id"), held_out.alias("held"),
                              whole_text(text_col).alias("text")).mapInArrow(
        _score(head), f"rid long, id {kind}, held_out boolean, n_tokens long, known long, "
                           "base double, lattice double, word string, tf long"), "lattice-parts")
    rest = parts.where("word is not null").select("rid", "word", "tf") \
        .join(valued.drop("all"), "word").groupBy("rid").agg(
            F.sum(F.col("tf") * F.col("w_known")).alias("k2"),
            F.sum(F.col("tf") * F.col("w_base")).alias("b2"),
            F.sum(F.col("tf") * F.col("w_lattice")).alias("s2"))
    rows = parts.where("word is null").drop("word", "tf").join(rest, "rid", "left")
    end_base = math.log10(model.train_docs + 0.5) - scale
    return rows.select(
        "id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("k2", F.lit(0)) + F.lit(int(model.train_docs > 0)))
        .alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("lattice") + F.coalesce("s2", F.lit(0.0)) + F.lit(model.end)).alias("score"))
