"""Packing token sequences into windows: non-negative least squares over length combinations.

1. Tasks tokenise whole texts. Every full window of a document is a sequence of
   its own; what is left (1 to window - 1 tokens) is a remainder.
2. The remainders' histogram has ``window - 1`` counts whatever the data. All
   pairs and triples of lengths that fill a window are enumerated, and their
   repeat counts solved by non-negative least squares against the histogram.
3. The counts are rounded within what is there. What is left over is packed
   greedily: laid out by length, largest first, and cut at the window's end.
4. A remainder finds its sequence by arithmetic from its rank among those of
   its length, so no piece is moved to meet the others of its sequence.

Results in special cases: a null or empty text is the end token alone. Rows
that repeat are separate documents. Only the last sequence of the greedy part
can be short of the window. An empty table gives no pieces.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.llm.common import store, whole_text
from jobsluice.operators.skew import BROADCAST_ROWS, is_small

PIECES = ("rid long, start long, length int, doc_tokens long, task int, rank long, ids binary")
PLACED = ("rid long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")
CUT_TYPES = [("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()),
             ("task", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())]
PLACED_TYPES = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


@dataclass(frozen=True)
class PackingSettings:
    window: int = 1024
    end_id: int = 0
    # Files of the public tokenizer package: the vocabulary, and the same merges as ranks.
    vocabulary: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"
    special: str = "<|endoftext|>"
    cached_words: int = 1_000_000
    rounds: int = 40
    steps: int = 60


class Tokens:
    """Ids of texts as little-endian 32-bit bytes.

    The byte-level pattern always starts a token at a space between two
    non-spaces and at a line feed between two, so texts are encoded word by word
    and words are remembered. The ranks hold the same merges as the vocabulary;
    texts with a special token's string go through the vocabulary itself.
    """

    def __init__(self, cfg: PackingSettings) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.cfg = cfg
        with open(public_tokenizers.path(cfg.ranks), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(cfg.vocabulary))
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_feed = self._bytes("\n")
        self.stops = {sign: self._bytes(sign) for sign in ".,"}

    def _bytes(self, text: str) -> bytes:
        ids = array("I", self.words.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """A word after a space. A stop or comma after a letter is a token of its own."""
        if word[-1] in self.stops and word[-2:-1].isalpha():
            stem = self.later.get(word[:-1])
            if stem is None:
                stem = self.later[word[:-1]] = self._bytes(" " + word[:-1])
            return stem + self.stops[word[-1]]
        return self._bytes(" " + word)

    def encode(self, text: str) -> bytes:
        if self.cfg.special in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        if not text:
            return b""
        lines = [line.split(" ") for line in text.split("\n")]
        if any("" in words for words in lines) \
                or sum(map(len, lines)) != len(text.split()):
            # White space beside white space, or of another kind: no cut is known to be safe.
            return self._bytes(text)
        first, later = self.first, self.later
        if len(first) + len(later) > self.cfg.cached_words:
            first.clear()
            later.clear()
        out = []
        for words in lines:
            ids = list(map(later.get, words))
            head = words[0]
            if head not in first:
                first[head] = self._bytes(head)
            ids[0] = first[head]
            if None in ids:
                for at, known in enumerate(ids):
                    if known is None:
                        word = words[at]
                        ids[at] = later[word] = self._word(word)
            out.append(b"".join(ids))
        return self.line_feed.join(out)


_TOKENS: dict[PackingSettings, Tokens] = {}


def tokens_of(cfg: PackingSettings) -> Tokens:
    """One tokenizer for each Python worker, kept between tasks."""
    if cfg not in _TOKENS:
        _TOKENS[cfg] = Tokens(cfg)
    return _TOKENS[cfg]


def _cut(cfg: PackingSettings):
    size, end = cfg.window, np.array([cfg.end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = tokens_of(cfg), TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, dtype=np.int64)
        rows, held, schema = [], 0, None
        for batch in batches:
            schema = pa.schema([("rid", batch.schema.field(0).type), *CUT_TYPES])
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start:4 * (start + size)]
                    length = len(piece) // 4
                    rows.append((rid, start, length, total, task, int(ranks[length]), piece))
                    ranks[length] += 1
                held += len(ids)
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths, ascending, that fill the window; 0 stands for none."""
    low = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(low), low, window - low], axis=1)
    triples = [np.stack([np.full(len(b), a), b, window - a - b], axis=1)
               for a in range(1, window // 3 + 1)
               if len(b := np.arange(a, (window - a) // 2 + 1))]
    return np.concatenate([pairs, *triples])


def solve(counts: np.ndarray, cfg: PackingSettings) -> tuple[np.ndarray, np.ndarray]:
    """``(combinations, repeats)`` that come nearest to the histogram, repeats not negative.

    Columns join the active set a few at a time: those of largest gradient that
    share no length. The active set's least squares is solved by accelerated
    projected gradients, and columns that fall to nothing leave it.
    """
    columns = combinations(cfg.window)
    scale = max(float(counts.max(initial=0)), 1.0)
    target = counts / scale
    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    in_use = np.zeros(len(columns), dtype=bool)

    def fitted(at, values):
        out = np.bincount(columns[at].ravel(), weights=np.repeat(values, 3),
                          minlength=cfg.window)[:cfg.window]
        out[0] = 0.0
        return out

    for _ in range(cfg.rounds):
        rest = target - fitted(active, x)
        rest[0] = 0.0
        gain = rest[columns].sum(axis=1)
        gain[in_use] = 0.0
        best = np.argpartition(-gain, min(4096, len(gain) - 1))[:4096]
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, chosen = np.zeros(cfg.window, dtype=bool), []
        for at in best[gain[best] > 0.5 / scale].tolist():
            lengths = columns[at][columns[at] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                chosen.append(at)
        if not chosen:
            break
        active = np.concatenate([active, np.array(chosen, dtype=np.int64)])
        x = np.concatenate([x, np.zeros(len(chosen))])
        # The largest eigenvalue is at most the largest column sum of the Gram matrix.
        uses = np.bincount(columns[active].ravel(), minlength=cfg.window)
        uses[0] = 0
        step = 1.0 / max(float(uses[columns[active]].sum(axis=1).max()), 1.0)
        y, t = x.copy(), 1.0
        for _ in range(cfg.steps):
            slope = (target - fitted(active, y))[columns[active]]
            slope[columns[active] == 0] = 0.0
            nearer = np.maximum(y + step * slope.sum(axis=1), 0.0)
            t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y = nearer + (t - 1) / t_next * (nearer - x)
            x, t = nearer, t_next
        live = x > 1e-9
        active, x = active[live], x[live]
        in_use[:] = False
        in_use[active] = True
    return columns[active], x * scale


@dataclass(frozen=True)
class Plan:
    """For each length: ranks below ``ends[k]`` go to ``sequences[k]`` onward, at ``offsets[k]``."""
    ends: list[np.ndarray]
    sequences: list[np.ndarray]
    offsets: list[np.ndarray]
    greedy_rank: np.ndarray     # first rank of a length that is packed greedily
    greedy_at: np.ndarray       # where the greedy pieces of a length begin, in tokens
    greedy_sequence: int
    full_sequence: int


def plan_packing(counts: np.ndarray, cfg: PackingSettings) -> Plan:
    """``counts[length]`` of all remainders; lengths 1 to window - 1."""
    counts = counts.astype(np.int64)
    columns, repeats = solve(counts.astype(float), cfg)
    used = np.zeros(cfg.window, dtype=np.int64)
    ends = [[] for _ in range(cfg.window)]
    sequences = [[] for _ in range(cfg.window)]
    offsets = [[] for _ in range(cfg.window)]
    sequence = 0
    for at in np.argsort(-repeats, kind="stable").tolist():
        lengths = [int(v) for v in columns[at] if v]
        need = {v: lengths.count(v) for v in lengths}
        times = min(int(repeats[at] + 0.5),
                    min(int(counts[v] - used[v]) // n for v, n in need.items()))
        if times < 1:
            continue
        offset = 0
        for v in lengths:
            used[v] += times
            ends[v].append(int(used[v]))
            sequences[v].append(sequence)
            offsets[v].append(offset)
            offset += v
        sequence += times
    left = counts - used
    left[0] = 0
    tokens = (left * np.arange(cfg.window))[::-1]
    at = np.concatenate([[0], np.cumsum(tokens)[:-1]])[::-1]
    total = int(tokens.sum())
    return Plan([np.array(e, dtype=np.int64) for e in ends],
                [np.array(s, dtype=np.int64) for s in sequences],
                [np.array(o, dtype=np.int64) for o in offsets],
                used, at.astype(np.int64), sequence, sequence + -(-total // cfg.window))


def _place(plan: Plan, cfg: PackingSettings):
    """Give pieces of known rank their sequences; greedy ones are cut at a window's end."""
    size = cfg.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("rid", batch.schema.field(0).type), *PLACED_TYPES])
            rids, starts, lengths, totals, ranks = (
                batch.column(k).to_pylist() for k in range(5))
            rows = []
            for rid, start, length, total, rank, ids in zip(
                    rids, starts, lengths, totals, ranks, batch.column(5)):
                ids = ids.as_py()
                if length == size:
                    rows.append((rid, start, size, total, plan.full_sequence + rank, 0, ids))
                elif rank < plan.greedy_rank[length]:
                    k = int(np.searchsorted(plan.ends[length], rank, side="right"))
                    before = int(plan.ends[length][k - 1]) if k else 0
                    rows.append((rid, start, length, total,
                                 int(plan.sequences[length][k]) + rank - before,
                                 int(plan.offsets[length][k]), ids))
                else:
                    at = int(plan.greedy_at[length]) \
                        + (rank - int(plan.greedy_rank[length])) * length
                    done = 0
                    while done < length:
                        offset = (at + done) % size
                        part = min(length - done, size - offset)
                        rows.append((rid, start + done, part, total,
                                     plan.greedy_sequence + (at + done) // size, offset,
                                     ids[4 * done:4 * (done + part)]))
                        done += part
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         cfg: PackingSettings = PackingSettings(),
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(id, start, length, doc_tokens, sequence_id, offset, ids)`` of every piece."""
    schema = PIECES.replace("rid long", f"rid {dict(docs.dtypes)[id_col]}")
    placed = PLACED.replace("rid long", f"rid {dict(docs.dtypes)[id_col]}")
    pieces = store(docs.select(F.col(id_col), whole_text(text_col).alias("text"))
                   .mapInArrow(_cut(cfg), schema), "packing-pieces")
    per_task = store(pieces.groupBy("task", "length").count(), "packing-counts")
    counts = np.zeros(cfg.window + 1, dtype=np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("count")).collect():
        counts[length] = n
    plan = plan_packing(counts[:cfg.window], cfg)
    # Ranks run on from task to task; a length has one row for each task here.
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")
    first = per_task.select("task", "length", before.alias("before"))
    if is_small(per_task, broadcast_rows):
        first = F.broadcast(first)
    ranked = pieces.join(first, ["task", "length"]).select(
        "rid", "start", F.col("length").cast("long"), "doc_tokens",
        (F.col("before") + F.col("rank")).alias("rank"), "ids")
    return ranked.mapInArrow(_place(plan, cfg), placed).withColumnRenamed("rid", "id")

