"""SimHash near-deduplication by exact comparison of tiles.

1. Each text's fingerprint is the majority, bit by bit, of the hashes of its
   word shingles. Texts with equal fingerprints act as one from here on.
2. Distinct fingerprints, sorted by the set bits of their four 16-bit words, are
   cut into tiles. The set bits of two words differ by no more than the words do,
   so two tiles whose ranges of counts lie further apart than the radius hold no
   link and are skipped. All other pairs of tiles are compared, every
   fingerprint with every other, by exclusive-or and bit counts.
3. A pair of tiles reports a forest over the links it found, never all pairs of
   a group. Components of the forests' union are the groups.

The comparison is exact and its work grows with the square of the number of
distinct fingerprints, less what the counts rule out.

Results in special cases: a text without words, or null, has fingerprint zero
and is linked like any other. Fewer words than a shingle form one shingle. The
component is the smallest id in it, null only if all its ids are. Repeated rows
are in one component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import store, whole_text
from jobsluice.operators.roles import connected_components

WORD_BITS = 16
WORDS = 64 // WORD_BITS


@dataclass(frozen=True)
class SimhashSettings:
    shingle_words: int = 4
    radius: int = 4
    seed: int = 42
    # Fingerprints of a tile: two tiles and a strip of their distances fit a task easily.
    tile: int = 4_096


def text_fingerprint(text: str, cfg: SimhashSettings = SimhashSettings()) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), cfg.shingle_words
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest, seed = xxhash.xxh64_intdigest, cfg.seed
    if len(words) <= size:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:])]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at:at + 65_536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(cfg: SimhashSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([text_fingerprint(t.as_py(), cfg) for t in batch.column(1)],
                              dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)],
                names=["id", "print", "mark"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 cfg: SimhashSettings = SimhashSettings()) -> DataFrame:
    """``(id, print, mark)``: the fingerprint, and a hash that tells texts apart."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"),
                       F.xxhash64(whole_text(text_col)).alias("mark")) \
        .mapInArrow(_fingerprints(cfg), f"id {kind}, print long, mark long")


def _word_counts(column: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(F.col(column), WORD_BITS * k)
                        .bitwiseAND(F.lit((1 << WORD_BITS) - 1))).alias(f"c{k}")
            for k in range(WORDS)]


def tiles(prints: DataFrame, total: int, cfg: SimhashSettings) -> DataFrame:
    """``(tile, cell, prints, low, high)``: distinct fingerprints of like counts.

    A cell has equal counts in its first words, as many words as make cells about
    as small as a tile; larger cells are dealt over several tiles by a hash.
    """
    names = [f"c{k}" for k in range(WORDS)]
    used = next((k for k in range(1, WORDS) if total <= 9 ** k * cfg.tile), WORDS)
    counted = prints.select("print", *_word_counts("print")) \
        .withColumn("cell", F.array(*names[:used]))
    # At most 17 counts for each word in use: a bounded table.
    sizes = counted.groupBy("cell").agg(F.ceil(F.count("*") / cfg.tile).cast("int").alias("parts"))
    rows = counted.join(F.broadcast(sizes), "cell").withColumn(
        "tile", F.concat_ws("-", F.col("cell").cast("array<string>"),
                            F.pmod(F.xxhash64("print"), F.col("parts"))))
    return rows.groupBy("tile", "cell").agg(
        F.sort_array(F.collect_list("print")).alias("prints"),
        F.array(*[F.min(n) for n in names]).alias("low"),
        F.array(*[F.max(n) for n in names]).alias("high"))


def _near_cells(cell: Column, used: int, radius: int) -> Column:
    """The cells whose counts are within the radius in all."""
    moves = [()]
    for _ in range(used):
        moves = [(*m, d) for m in moves for d in range(-radius, radius + 1)
                 if sum(map(abs, m)) + abs(d) <= radius]
    table = F.array(*[F.array(*[F.lit(d) for d in m]) for m in moves])
    return F.transform(table, lambda m: F.zip_with(cell, m, lambda a, b: a + b))


def tile_pairs(tiled: DataFrame, used: int, cfg: SimhashSettings) -> DataFrame:
    """``(left, right)`` tiles that can hold a link, each pair once."""
    meta = tiled.select("tile", "cell", "low", "high")
    ahead = meta.withColumn("cell", F.explode(_near_cells(F.col("cell"), used, cfg.radius)))
    met = ahead.alias("l").join(meta.alias("r"), "cell").where("l.tile <= r.tile")
    apart = F.lit(0)
    for k in range(WORDS):
        apart = apart + F.greatest(F.col("l.low")[k] - F.col("r.high")[k],
                                   F.col("r.low")[k] - F.col("l.high")[k], F.lit(0))
    return met.where(apart <= cfg.radius).select(
        F.col("l.tile").alias("left_tile"), F.col("r.tile").alias("right_tile"))


def _links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A forest over the links between two tiles, as pairs of fingerprints."""
    both = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(both))
    edges = []
    for at in range(0, len(left), 256):
        strip = left[at:at + 256]
        near = np.bitwise_count(strip[:, None] ^ right[None, :]) <= radius
        if same:
            near[np.arange(len(strip)), np.arange(at, at + len(strip))] = False
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            met = np.flatnonzero(near[row]) + shift
            own = at + row
            apart = met[label[met] != label[own]]
            if not len(apart):
                continue
            _, firsts = np.unique(label[apart], return_index=True)
            for other in apart[firsts].tolist():
                edges.append((int(both[own]), int(both[other])))
            joined = np.append(label[apart], label[own])
            label[np.isin(label, joined)] = joined.min()
    return edges


def _compare(cfg: SimhashSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two, same in zip(batch["left"], batch["right"], batch["same"]):
                left = np.asarray(one, dtype=np.int64).view(np.uint64)
                right = np.asarray(two, dtype=np.int64).view(np.uint64)
                edges = np.array(_links(left, right, cfg.radius, same), dtype=np.uint64)
                if len(edges):
                    edges = edges.view(np.int64)
                    yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})
    return run


def find_links(prints: DataFrame, cfg: SimhashSettings = SimhashSettings()) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that join up all groups."""
    tiled = store(tiles(prints, prints.count(), cfg), "simhash-tiles")
    first = tiled.select(F.size("cell")).first()
    used = first[0] if first else 1
    sides = [tiled.select(F.col("tile").alias(f"{side}_tile"), F.col("prints").alias(side))
             for side in ("left", "right")]
    work = tile_pairs(tiled, used, cfg).join(sides[0], "left_tile").join(sides[1], "right_tile") \
        .select("left", "right", (F.col("left_tile") == F.col("right_tile")).alias("same"))
    return store(work.mapInPandas(_compare(cfg), "a long, b long"), "simhash-links")


@dataclass(frozen=True)
class NearGroups:
    rows: DataFrame         # id, print, mark of every row
    groups: DataFrame       # print, component_id, and the id and mark of the row that stays


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                cfg: SimhashSettings = SimhashSettings()) -> NearGroups:
    rows = store(fingerprints(docs, id_col, text_col, cfg), "simhash-rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    prints = store(rows.groupBy("print").agg(F.min(first).alias("first")), "simhash-prints")
    components = connected_components(find_links(prints.select("print"), cfg))
    named = store(prints.join(components.withColumnRenamed("node", "print"), "print", "left")
                  .withColumn("component", F.coalesce("component", "print")), "simhash-named")
    # Both sides of the join are stored tables, so that a very large group can be split.
    least = store(named.groupBy("component").agg(F.min("first").alias("stays")), "simhash-least")
    groups = named.select("print", "component").join(least, "component").select(
        "print", F.col("stays.id").alias("component_id"), F.col("stays.mark").alias("stays_mark"))
    return NearGroups(rows, store(groups, "simhash-groups"))


def component_of(found: NearGroups) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row."""
    return found.rows.join(found.groups, "print").select(
        "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     cfg: SimhashSettings = SimhashSettings()) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns."""
    found = near_groups(docs, id_col, text_col, cfg)
    stays = found.groups.select(F.col("component_id").alias("_id"),
                                F.col("stays_mark").alias("_stays")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"),
                       F.xxhash64(whole_text(text_col)).alias("_mark"))
    kept = rows.join(stays, F.col("_own").eqNullSafe(F.col("_id"))
                     & (F.col("_mark") == F.col("_stays")), "left_semi")
    if not found.rows.groupBy("id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_own", "_mark"])
    return kept.select("_row.*")
