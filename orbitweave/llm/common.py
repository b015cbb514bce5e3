"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.storage import shared_folder, table, written

__all__ = ["arrow_map", "batch_of", "counted_out", "crc32_of", "free_of", "grouped_batches", "mix64", "session_for_texts", "shared_folder", "spans_of_size", "table", "texts_of", "word_hashes", "written"]

#: Rows in an Arrow batch. Texts can be 100 KB and more, so batches are kept short.
BATCH_ROWS = 500


def session_for_texts(spark: SparkSession) -> None:
    """Keeps Arrow batches short enough for long texts; a smaller setting of the session stays."""
    workers.prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def crc32_of(column: Column | str) -> Column:
    """Unsigned CRC-32 of a value's text; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary"))


def counted_out(rows: DataFrame, own: list[str], first: str, copies: str, into: str, run: int = 4096) -> DataFrame:
    """own columns of each row as often as its copies say, numbered from first. Runs of copies are dealt
    out before they are expanded, so a row that stands for a third of all is not one task's work."""
    runs = rows.withColumn("_run", F.explode(F.expr(f"sequence(0L, ({copies} - 1) div {run})")))
    numbers = F.expr(f"sequence({first} + _run * {run}, {first} + least({copies}, (_run + 1) * {run}) - 1)")
    return runs.select(*own, F.explode(numbers).alias(into))


def free_of(keep: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns keep, each once, less those whose names new columns take (in any case of letters)."""
    taken = {n.lower() for n in new}
    return [c for c in dict.fromkeys(keep) if c.lower() not in taken]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty string."""
    return [x if x is not None else "" for x in column.to_pylist()]


def spans_of_size(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most that many characters together (a longer text is alone),
    so that the words of a batch of long texts are not all in memory at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over record batches; function takes and gives an iterator of batches."""
    session_for_texts(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[k], pa.Array) else pa.array(x, t) for k, t in types.items()], names=list(types))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 values: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of words; the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def grouped_batches(batches: Iterator[pa.RecordBatch], bytes_at_least: int) -> Iterator[pa.RecordBatch]:
    """Joins short batches until they hold that many bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= bytes_at_least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        got = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield got[0] if got else held[0]
