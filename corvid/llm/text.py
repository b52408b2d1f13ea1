"""Column expressions that several operators share; all run inside the JVM."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of the white-space kind, and of the alphanumeric kind (after lower-casing).
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_ALNUM_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; the fast built-in serves texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str = SPACE_CLASS) -> Column:
    """The words between runs of separators; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, separators + "+"), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """64 bits that stand for a text when rows of one doc_id are told apart."""
    return F.xxhash64(text)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark df for broadcast if it has at most most_rows rows, else leave it to a shuffled join.

    df has to be cheap to count, such as a shared table.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], rows: str, most: int, most_broadcast: int) -> DataFrame:
    """The inner join of many rows with few, which has one row for each of its keys and says in a
    column how many of the rows share it. Both have to be cheap to read twice, such as shared tables.

    Keys that over `most` rows share are few; they are broadcast apart, so that no task gathers one.
    """
    if few.limit(most_broadcast + 1).count() <= most_broadcast:
        return many.join(F.broadcast(few), keys)
    hot = shared_table(few.where(F.col(rows) > most), "hot-keys")
    if not hot.limit(1).count():
        return many.join(few, keys)
    hot = bounded_broadcast(hot, most_broadcast)
    rest = many.join(hot.select(*keys), keys, "left_anti").join(few.where(F.col(rows) <= most), keys)
    return many.join(hot, keys).unionByName(rest)


#: Rows with whole texts that go to Python at once.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold TEXT_ROWS rows, as texts may be long; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(TEXT_ROWS))


def give_back() -> None:
    """Return freed memory of this Python worker to the system, where the C library can: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, underscored until df has no column that differs from them by case alone."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
