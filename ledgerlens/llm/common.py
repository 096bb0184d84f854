"""Helpers shared by the training-data operators.

* ``add_columns``: row-wise work in Arrow batches, input columns pass through,
  so a row-wise operator is one narrow stage (no shuffle, any partitioning,
  a lost executor only repeats its own tasks).
* ``write_table`` / ``drop_table``: cut lineage with a table in the shared
  checkpoint folder and delete it once nothing reads it any more.
* word rules of the contracts, as byte tables: ASCII separators never split a
  UTF-8 character, so ``bytes.translate().split()`` is exact and never decodes.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = bytes(
    (c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: Lower-cases A-Z only; ``split()`` of bytes then cuts at ``[\x20\x09-\x0D]+``.
LOWER = bytes((c + 32) if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def release_memory() -> None:
    """Give back the Arrow memory that a finished task has left unused: Python
    workers are kept for later stages, and so would be what their pools hold."""
    pa.default_memory_pool().release_unused()


def trim_memory() -> None:
    """``release_memory``, and the C library's part: large arrays that are freed
    one between others stay with a worker otherwise."""
    release_memory()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def add_columns(df: DataFrame, fields: list[StructField], make: Callable) -> DataFrame:
    """``df`` with computed columns. ``make()`` runs once per task and returns a
    function from an Arrow batch to one array per field. Input columns of the
    same name are replaced."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches):
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + compute(batch), names=names)
        release_memory()

    return df.mapInArrow(run, StructType(kept + fields))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def write_table(df: DataFrame, name: str, compression: str = "zstd", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage is
    cut and a lost executor re-reads files. ``rows_per_file``: at most so many,
    for rows of megabytes; 0 leaves it to the session."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def n_input_partitions(df: DataFrame) -> int:
    """Partitions of the input, which grow with its bytes."""
    return max(1, df.rdd.getNumPartitions())


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
