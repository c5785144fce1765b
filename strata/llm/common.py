"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only where it is unset (tests,
    a single machine) a temporary one is made and remembered in the session."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = spark.conf.get("spark.strata.shared.dir", None)
        if not known:
            known = "file://" + tempfile.mkdtemp(prefix="strata-shared-")
            spark.conf.set("spark.strata.shared.dir", known)
    return known if urlsplit(known).scheme else f"file://{known}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it again: what follows doesn't depend on
    executors that made it, and a frame used several times is computed once. A table that a result still reads
    can't be deleted by the operator; every table goes when the driver's JVM ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/strata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    folder, at = _folder(out)
    folder.deleteOnExit(at)
    return out


def _folder(table: DataFrame):
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table._table_path)
    return path.getFileSystem(session._jsc.hadoopConfiguration()), path


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() made, once nothing that is still to run reads them."""
    for table in tables:
        folder, at = _folder(table)
        folder.delete(at, True)
        folder.cancelDeleteOnExit(at)


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory stays with the process
        return None


def give_back() -> None:
    """Returns freed memory to the system. A Python worker is used again by other stages, beside an executor's heap; without this it keeps the
    most that any of its tasks had."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that gives back memory when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, unchanged and in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its content, so that repeated ids with other texts stay apart and whole repeated
    rows, whose results are equal, share a key."""
    return F.xxhash64(doc_id, F.length(text), text)


def unused(name: str, columns: list[str]) -> str:
    """name, or with underscores put before it until no column has it or begins with it, whatever the case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name
