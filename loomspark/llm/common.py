"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.shared import checked_broadcast, drop_stored, shared_dir, store

__all__ = ["checked_broadcast", "drop_stored", "shared_dir", "store"]  # re-exported

#: A word is a run of anything but ASCII blanks; the same set in Python and Java patterns.
BLANKS = r" \t-\r"
WORD = f"[^{BLANKS}]+"
#: Rows whose crc32(doc_id as text) mod FOLDS equals HELD_OUT never train a model.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows kept from training; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, inside one projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANKS}]+|[{BLANKS}]+$", ""), f"[{BLANKS}]+")
    return F.filter(cut, lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (f"{name}_{i}" for i in range(len(taken) + 1)) if c not in taken)


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most so many, cut where a step of an eighth of a doubling ends; all if there are no more.

    A histogram of counts finds the cut, so nothing is sorted and only that comes to the driver.
    """
    step = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * 8)
    found = sorted(((r["step"], r["k"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for at, k in found:
        if total + k > most:
            break
        total, least = total + k, at
    return rows.filter(F.lit(False)) if least is None else rows.filter(step >= least)


#: Rows and bytes of texts that are handed to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of long texts, unless the session asks for its own batch size."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def release_memory() -> None:
    """Hands freed memory back to the system: a Python worker lives on after its task, beside those of later stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
