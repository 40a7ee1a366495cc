"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage  # noqa: F401

#: Code points that end a word: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id, mod: int, rest: int):
    """crc32 of the id as text, modulo mod, equals rest. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod == rest


def utf8(text: str | None) -> bytes:
    """Null is empty; lone surrogates, which Arrow never delivers, would be kept."""
    return (text or "").encode("utf-8", "surrogatepass")


def part_batches(batches, most: int = 1 << 20, column: str = "text"):
    """The rows of Arrow batches again, in batches of about most bytes of column, of one row at least: what a task turns
    into Python objects at once is bounded by that, not by the number of rows that Spark sends."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            end = max(k + 1, int(np.searchsorted(size, most + (size[k - 1] if k else 0), side="right")))
            yield batch.slice(k, end - k)
            k = end


def release() -> None:
    """Freed memory goes back to the system: Python workers are used again, and would else keep their greatest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def tidy(work):
    """work, a function of Arrow batches, that releases memory when its task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Queries that end in here delete their shuffle files when they do. For large steps whose result is written as a table:
    else the files of all steps add up on disk until the driver's JVM collects what refers to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def own_name(name: str, taken) -> str:
    """name, with underscores added until no column has it (names are alike whatever their case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def renamed(fields, taken) -> list[str]:
    """Names of kept columns beside an operator's own (taken): a column whose name clashes gets underscores at its end."""
    taken, out = list(taken), []
    for f in fields:
        out.append(own_name(f.name, taken))
        taken.append(out[-1])
    return out
