"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20
#: Bytes of rows that Spark sends to a Python worker at a time. A batch is held by the JVM and by the worker,
#: and ends behind the row that fills it, so the limit lies below a slice.
BATCH_BYTES = 6 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, underlined until no column of ``frame`` has it (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.sparkContext.getConf().get("spark.local.dir", "/tmp/newsloom-shared")
    return f"{top}/{uuid.uuid4().hex}"


def keep(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and allocators keep what a task took at most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    frame: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``frame.mapInArrow`` with batches of about ``BATCH_BYTES``, unless the session has a limit of its own.

    A task ends with ``done`` and gives its memory back.
    """
    conf = frame.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if done is not None:
                done()
            give_back()

    return frame.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold ``limit`` bytes at most, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    begin, held = 0, 0
    for row, value in enumerate(lengths):
        size = 0 if not value.is_valid else len(value.as_buffer())
        if row > begin and held + size > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [value or b"" for value in values.cast(pa.binary()).to_pylist()]


def add_columns(
    frame: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list],
    drop_text: bool = False,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``frame`` with columns computed by ``make`` from slices of its Arrow batches, row by row, without a shuffle.

    ``make`` gets a batch and returns one list or Arrow array per field. Fields
    must not clash with columns of ``frame`` (see :func:`fresh`). ``done`` is called when a task ends.
    """
    kept = [f for f in frame.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            for part in slices(batch, text):
                made = [
                    value if isinstance(value, pa.Array) else pa.array(value, type=kinds.field(i).type)
                    for i, value in enumerate(make(part))
                ]
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(old + made, names=names + [f.name for f in fields])

    return map_batches(frame, run, schema, done)
