"""What the operators share: reading tables, tables written to cut lineage, Arrow passes, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import configure, shared_dir

#: Arrow batches end at so many rows or bytes, whichever comes first.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the Arrow passes count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lost executors cost nothing that came before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def passing(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` that pass through: all but those named like one of ``made``, in whatever case."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def prefix(df: DataFrame) -> str:
    """Underscores enough that no column of ``df`` begins with them."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of))


def worker_state(key: object, make: Callable[[], object]) -> object:
    """Something costly to build that one Python worker keeps between its tasks, until another is asked for."""
    held = sys.modules.setdefault("keepsake_worker_state", types.ModuleType("keepsake_worker_state"))
    if getattr(held, "kept", (None,))[0] != key:
        held.kept = None
        released()
        held.kept = (key, make())
    return held.kept[1]


def released() -> None:
    """Give memory that nothing uses any more back to the system: workers outlive the passes they run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and the n + 1 places where texts begin. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    starts = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[starts[0]:starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together; a longer text is a run of its own."""
    at = 0
    while at < len(starts) - 1:
        end = int(np.searchsorted(starts, starts[at] + size, "right")) - 1
        yield at, (end := max(end, at + 1))
        at = end


def passed(df: DataFrame, change: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One Arrow pass: ``change`` turns the table of a batch into the table of its results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from change(pa.Table.from_batches([b])).combine_chunks().to_batches()
    return arrow_pass(df, run, schema)


def arrow_pass(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, whose tasks leave no memory behind them in the worker but its state."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()
    return df.mapInArrow(task, schema)
