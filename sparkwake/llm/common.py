"""Shared plumbing of the training-data operators: tables, scratch space, text normalisation."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a maximal run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE, _SPACE_BYTES = re.compile(r"[\x20\x09-\x0D]"), re.compile(rb"[\x20\x09-\x0D]")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_own_root: dict[str, str] = {}
_cached: dict[tuple, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task. Only one thing at a time: workers outlive stages, and other operators' caches go."""
    if key not in _cached:
        _cached.clear()
        give_back()
        _cached[key] = make()
    return _cached[key]


class Remembered(dict):
    """Results by key, made when first asked for. Once there are ``most`` they become the old ones, of which those asked for again stay."""

    def __init__(self, make: Callable[[Any], Any], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Any) -> Any:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def forget(self) -> None:
        """To be called between batches."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def give_back() -> None:
    """Return memory that is free to the system; allocators would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """A function of mapInArrow, with give_back() at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def small_batches(spark: SparkSession, rows: int = 512, mb: int = 4) -> None:
    """Bound what one Arrow batch holds, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def pieces(text: str | bytes, size: int = 1 << 20) -> Iterator[str | bytes]:
    """A text in parts that end before white space, so that the words of a giant text need not be held at once."""
    space = _SPACE_BYTES if isinstance(text, bytes) else _SPACE
    at = 0
    while at < len(text):
        found = space.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = "file://" + tempfile.mkdtemp(prefix="sparkwake-")
        root = _own_root[app]
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives executor loss.

    The write's own shuffle files go as soon as it is done, instead of when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/sparkwake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many intermediate tables there are; for drop_since."""
    return len(_written)


def drop_since(mark: int) -> None:
    """Delete the intermediate tables written since then but the last, which stands on none of them."""
    for spark, path in _written[mark:-1]:
        _delete(spark, path)
    del _written[mark:-1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter: its folder goes with the application
            return


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; text without other letters takes the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_int(*parts: Column | str) -> Column:
    """Non-negative 32-bit hash of the '|'-joined parts, the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
