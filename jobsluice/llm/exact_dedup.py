"""Exact deduplication over an extendible-hash index in shared files.

1. Every document gets a 64-bit key. Counting the keys under each prefix gives
   the load of the hash space; the directory starts with one bucket and doubles
   while an overfull bucket is as deep as itself.
2. Map tasks collapse equal texts of each batch before anything is shuffled,
   so a text that a third of all rows share sends one entry a batch.
3. Neighbouring buckets form the key range of one owner task. An owner reads
   its entries in key order, chains the texts that collide on a key, compares
   them byte by byte and merges equal ones.
4. The owners' entries are the index; documents look themselves up in it.

Results in special cases: a null text equals the empty text. Of equal texts the
row with the largest id stays, null ids last; of rows that repeat both id and
text exactly one stays. An empty table gives an empty result. Columns beside id
and text are carried whole and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsluice.llm.common import store, tasks, whole_text

MAX_DEPTH = 18


@dataclass(frozen=True)
class DedupSettings:
    # Distinct keys a bucket holds before it is split, at least.
    bucket_keys: int = 256
    # The directory is planned for this many buckets at most, whatever the data.
    max_buckets: int = 65_536


class Directory:
    """Which bucket each key prefix points to."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = [0]
        self.local = [0]

    def split(self, bucket: int, prefix: int) -> int:
        """Part the bucket of ``prefix`` by one more bit; the directory doubles where it must."""
        if self.local[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        first = prefix << (self.depth - self.local[bucket])
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        span = 1 << (self.depth - self.local[bucket])
        for slot in range(first + span, first + 2 * span):
            self.slots[slot] = len(self.local) - 1
        return len(self.local) - 1


def grow_directory(loads: np.ndarray, capacity: int) -> Directory:
    """Split until no bucket holds more than ``capacity`` keys.

    ``loads`` counts the keys under each prefix of a fixed depth, which is also
    as deep as the directory may get; a fuller bucket at that depth stays whole.
    """
    deepest = len(loads).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(loads)])
    directory, todo = Directory(), [(0, 0, 0)]
    while todo:
        bucket, depth, prefix = todo.pop()
        low, high = prefix << (deepest - depth), (prefix + 1) << (deepest - depth)
        if depth < deepest and sums[high] - sums[low] > capacity:
            upper = directory.split(bucket, prefix)
            todo += [(bucket, depth + 1, 2 * prefix), (upper, depth + 1, 2 * prefix + 1)]
    return directory


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _directory_of(members: DataFrame, cfg: DedupSettings) -> tuple[Directory, np.ndarray]:
    total = members.count()
    capacity = max(cfg.bucket_keys, -(-total // cfg.max_buckets))
    depth = min(MAX_DEPTH, max(total // capacity, 1).bit_length() + 2)
    loads = np.zeros(1 << depth, dtype=np.int64)
    for prefix, n in members.groupBy("key").agg(F.lit(1).alias("one")) \
            .groupBy(_prefix(F.col("key"), depth).alias("prefix")).count().collect():
        loads[prefix] = n
    return grow_directory(loads, capacity), loads


def _owners(directory: Directory, loads: np.ndarray, count: int) -> np.ndarray:
    """The owner task of each slot: neighbouring buckets, about equal loads."""
    slots = np.asarray(directory.slots)
    per_slot = loads.reshape(len(slots), -1).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(per_slot)[:-1]])
    first = np.concatenate([[True], slots[1:] != slots[:-1]])
    start = np.maximum.accumulate(np.where(first, before, 0))
    return (start * count // max(int(per_slot.sum()), 1)).clip(0, count - 1).astype(np.int32)


def _merge(key: np.ndarray, texts: pa.Array, ids: pa.Array, n: np.ndarray, same: np.ndarray):
    """Chains per key: the row that stays, the rows it stands for, and its repeats."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) \
        if len(order) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(order))
    stays, total, repeats, slot = [], [], [], []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if end - start == 1:
            at = int(order[start])
            stays.append(at)
            total.append(int(n[at]))
            repeats.append(int(same[at]))
            slot.append(0)
            continue
        chain: list[list] = []
        for at in order[start:end].tolist():
            body, doc = texts[at].as_py() or "", ids[at].as_py()
            rank = (doc is not None, doc)
            for link in chain:
                if link[0] == body:
                    link[3] += int(n[at])
                    if rank == link[1]:
                        link[4] += int(same[at])
                    elif rank[0] > link[1][0] or (rank[0] and rank[1] > link[1][1]):
                        link[1:3], link[4] = [rank, at], int(same[at])
                    break
            else:
                chain.append([body, rank, at, int(n[at]), int(same[at])])
        for place, (_, _, at, rows, equal) in enumerate(chain):
            stays.append(at)
            total.append(rows)
            repeats.append(equal)
            slot.append(place)
    return stays, total, repeats, slot


def _merged(table: pa.Table, text_at: int, id_at: int) -> pa.Table:
    row = pa.concat_arrays(table.column("row").chunks)
    stays, total, repeats, slot = _merge(
        table.column("key").to_numpy(), row.field(text_at), row.field(id_at),
        table.column("n").to_numpy(), table.column("same").to_numpy())
    kept = table.take(pa.array(stays, pa.int64()))
    for name, values, kind in (("n", total, pa.int64()), ("same", repeats, pa.int64()),
                               ("slot", slot, pa.int32())):
        kept = kept.set_column(kept.column_names.index(name), name, pa.array(values, kind))
    return kept


def _collapse(slots: np.ndarray, owners: np.ndarray, depth: int, text_at: int,
              id_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ones = pa.array(np.ones(batch.num_rows, dtype=np.int64))
            none = pa.array(np.zeros(batch.num_rows, dtype=np.int32))
            table = pa.table({"owner": none, "bucket": none, "slot": none,
                              "key": table.column("key"), "n": ones, "same": ones,
                              "row": table.column("row")})
            table = _merged(table, text_at, id_at)
            prefix = table.column("key").to_numpy().astype(np.uint64) >> np.uint64(64 - depth) \
                if depth else np.zeros(table.num_rows, dtype=np.uint64)
            prefix = prefix.astype(np.int64)
            table = table.set_column(0, "owner", pa.array(owners[prefix], pa.int32()))
            table = table.set_column(1, "bucket", pa.array(slots[prefix], pa.int32()))
            yield from table.to_batches()
    return run


def _own(text_at: int, id_at: int):
    """Merge sorted entries; only the last key's chain waits for the next batch."""
    def run(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            table = _merged(table, text_at, id_at)
            keys = table.column("key").to_numpy()
            last = int(np.count_nonzero(keys == keys[-1]))
            waiting = table.slice(table.num_rows - last)
            yield from table.slice(0, table.num_rows - last).to_batches()
        if waiting is not None:
            yield from waiting.to_batches()
    return run


@dataclass(frozen=True)
class DedupIndex:
    members: DataFrame      # rid, id, key, text_sha256 of every row
    owned: DataFrame        # what the owners merged: key, slot, n, same, row
    directory: Directory


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                cfg: DedupSettings = DedupSettings(),
                key: Callable[[Column], Column] = F.xxhash64) -> DedupIndex:
    text = whole_text(text_col)
    members = store(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        key(text).cast("long").alias("key"), F.sha2(text.cast("binary"), 256).alias("text_sha256")),
        "dedup-members")
    directory, loads = _directory_of(members, cfg)
    count = tasks(docs.sparkSession)
    owners = _owners(directory, loads, count)
    at = docs.columns.index(text_col), docs.columns.index(id_col)
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    schema = T.StructType([
        T.StructField("owner", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("slot", T.IntegerType()), T.StructField("key", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("same", T.LongType()),
        T.StructField("row", row)])
    entries = docs.select(key(text).cast("long").alias("key"),
                          F.struct(*docs.columns).alias("row")) \
        .mapInArrow(_collapse(np.asarray(directory.slots, dtype=np.int32), owners,
                              directory.depth, *at), schema)
    owned = entries.repartitionById(count, F.col("owner")) \
        .sortWithinPartitions("bucket", "key").mapInArrow(_own(*at), schema)
    return DedupIndex(members, owned, directory)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 cfg: DedupSettings = DedupSettings(),
                 key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256, bucket, slot)`` of every row."""
    index = build_index(docs.select(id_col, text_col), id_col, text_col, cfg, key)
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    entries = store(index.owned.select(
        "bucket", "slot", "key", F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.col(f"row.{id_col}").alias("keep_id"), "n", "same"), "dedup-index")
    rows = index.members.join(entries, ["key", "text_sha256"])
    chosen = F.col("id").eqNullSafe(F.col("keep_id"))
    repeated = entries.where("same > 1")
    if not repeated.isEmpty():
        # Rows that repeat the id that stays: the first one written stands for them.
        first = rows.where(chosen & (F.col("same") > 1)).groupBy("key", "text_sha256") \
            .agg(F.min("rid").alias("first_rid"))
        rows = index.members.join(entries.join(first, ["key", "text_sha256"], "left"),
                                  ["key", "text_sha256"])
        chosen = chosen & F.coalesce(F.col("rid") == F.col("first_rid"), F.lit(True))
    return rows.select("id", "keep_id", F.col("n").alias("group_size"), chosen.alias("kept"),
                       "text_sha256", "bucket", "slot")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                cfg: DedupSettings = DedupSettings()) -> DataFrame:
    """The rows that stay, with all their columns; they come straight from the owners."""
    return build_index(docs, id_col, text_col, cfg).owned.select("row.*")
