"""What several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_WORDS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that no piece holds much more than ``most_bytes`` (one row at least)."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Gives memory that this process has freed, but that its allocators hold on to, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def given_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the batches of a task, after which its process gives back what it no longer needs.

    Python workers live on from task to task, and stand idle beside later stages that need the executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class HashedWords(dict):
    """Word -> 64-bit hash of its normal form; looked up far more often than computed.

    Keys are words as they stand in a text. ``normal`` gives the form that is hashed; a word whose
    form is empty gets 0. The table is emptied when it is full, so it never outgrows a task.
    """

    def __init__(self, normal, most: int = 500_000):
        super().__init__()
        self.normal, self.most = normal, most

    def __missing__(self, word: str) -> int:
        form = self.normal(word)
        if len(self) >= self.most:
            self.clear()
        found = self[word] = (xxhash.xxh3_64_intdigest(form.encode()) | 1) if form else 0
        return found

    def of(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that low bits are as good as high ones."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole if it is shorter, none if it is empty."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    # Runs double in length, and those whose lengths add up to the size are strung together.
    total, done, run, factor = np.zeros(n, np.uint64), 0, words, 0x9E3779B97F4A7C15
    for k in range(size.bit_length()):
        length = 1 << k
        if size & length:
            total = total * np.uint64(factor) + run[done : done + n] if done else run[:n]
            done += length
        if done < size:
            run, factor = run[:-length] * np.uint64(factor) + run[length:], factor * factor % (1 << 64)
    return mixed(total + np.uint64(size))


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def bitmap(hashes: DataFrame) -> Column:
    """The hashes of a one-column frame as a bitmap of fixed size (half a megabyte): an array of 64-bit words, as a scalar.

    What passes it may be in the frame, and what is in the frame passes. It only saves shuffling rows that a join
    would drop; once it is full it saves nothing and costs no more.
    """
    place = F.pmod(F.col(hashes.columns[0]), F.lit(64 * BITMAP_WORDS))
    marked = hashes.select(div(place, 64).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    words = marked.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = hashes.sparkSession.range(BITMAP_WORDS).withColumnRenamed("id", "at").join(words, "at", "left")
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.select(F.transform(listed, lambda x: x["bits"])).scalar()


def passes(value: Column, words: Column) -> Column:
    place = F.pmod(value, F.lit(64 * BITMAP_WORDS))
    return F.getbit(F.get(words, div(place, 64).cast("int")), (place % 64).cast("int")) == 1
