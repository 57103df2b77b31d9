"""Small helpers of the corpus operators."""

import ctypes
import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quadweave.runtime import shared_folder

# A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of text a task hands to Python at once.
BATCH_BYTES = "8m"
SPACES = "\t\n\x0b\x0c\r "
WORD_SQL = r"[^\x20\x09-\x0D]+"


def work_folder(spark, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{shared_folder(spark).rstrip('/')}/quadweave/{name}-{uuid.uuid4().hex}"


@contextmanager
def bounded_batches(spark):
    """Arrow batches of at most ``BATCH_BYTES`` for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, sizes are known."""
    path = work_folder(df.sparkSession, name)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows=512):
    """Arrow batches in slices of few rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_slices(batches, column, max_bytes=1_000_000, rows=512):
    """Arrow batches in slices whose texts hold about ``max_bytes`` together; one longer text is a slice."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), "i8")
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(int(np.searchsorted(ends, before + max_bytes, "right")), at + rows))
            yield batch.slice(at, stop - at)
            at = stop


def quoted(name: str):
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, *names):
    """(``df`` with its columns named c0, c1, ... in order, the new names of ``names``).

    Inside an operator no name of its input can then clash with a working column, whatever it holds;
    ``toDF(*df.columns)`` gives the names back.
    """
    at = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(at))]), *(f"c{at.index(n)}" for n in names)


#: Functions that drop what a Python worker keeps from one task to the next.
KEPT_BY_WORKERS = []


def give_back(keep=False):
    """End of a task's work on texts: hand free memory back to the system.

    Python workers outlive their tasks and serve other operators next. Unless ``keep`` says that the
    next task is likely of the same kind, what earlier tasks kept (tokenizers, words) is dropped too.
    """
    if not keep:
        for drop in KEPT_BY_WORKERS:
            drop()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


# A C library without this function keeps freed pages; nothing else depends on it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def each_slice(texts: pa.Array, change, rows=512) -> list:
    """``change`` of every value of an array, of which few are held as Python objects at once."""
    out = []
    for i in range(0, len(texts), rows):
        out.append(change(texts.slice(i, rows).to_pylist()))
    return out


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def words_of(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text; ``bytes.split`` cuts at exactly the six ASCII characters."""
    return raw.split()
