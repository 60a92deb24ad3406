"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsluice.session import scratch_dir

# A word: a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What was written stays the same when a task is run again, so later steps
    may rely on row numbers and task numbers in it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(_row, _text)``: the whole row apart from what an operator computes.

    Extra columns of any name can then not clash with those of the operator.
    """
    return docs.select(F.struct(*docs.columns).alias("_row"), whole_text(text).alias("_text"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """All rows, or a little under ``most`` of them, by a hash of the columns ``by``.

    For fitting only. A share is kept by a filter, so nothing is sorted and each
    task sends on its share alone. The share lies six standard deviations below
    ``most``, so that the limit does not cut where ``by`` tells the rows apart.
    """
    total = rows.count()
    if total <= most:
        return rows
    kept = F.pmod(F.xxhash64(*by), F.lit(total)) < int(most - 6 * most ** 0.5)
    return rows.where(kept).limit(most)


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, between ASCII white space, about ``size`` bytes at a time.

    However long a text is, the words of one part of it are held at once.
    """
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def id_remainder(column: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo 5: null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5
