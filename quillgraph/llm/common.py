"""Helpers that the operators share: the shared folder, written tables, size-checked joins, tokens.

Words everywhere are maximal runs outside ``[\\x20\\x09-\\x0D]``.  On UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` touches A-Z alone, so the Python operators work on bytes.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of its files, up to which a written table may be broadcast; beyond either a shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

#: Null ids join, group and order as this value, which no table uses: the greatest, so that nulls come last.
NULL_ID = 2**63 - 1

SPACE = " \t\n\x0b\x0c\r"


def by_value(module: str) -> None:
    """Executors need not have this package: functions of the module travel inside the task."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def worker_cache() -> dict:
    """A dict that outlives a task in a reused Python worker."""
    return sys.__dict__.setdefault("_quillgraph_worker_cache", {})


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and the master is local, a temporary one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="quillgraph-")
        root = "file://" + shared_dir.own
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batches, rows: int = 256):
    """Record batches in smaller pieces, so that a worker unpacks few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


#: Rows of a record batch that goes to a Python worker, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's record batches: texts are long, and both sides of the pipe hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Table:
    """A table written once to the shared folder: lineage ends here, and lost executors cost nothing."""

    #: Tables of the scopes that are open, the innermost last.
    scopes: list[list[Table]] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        self._rows: int | None = None
        self._bytes: int | None = None
        if self.scopes:
            self.scopes[-1].append(self)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df().count()
        return self._rows

    def bytes(self) -> int:
        """Of the table's files."""
        if self._bytes is None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            self._bytes = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return self._bytes

    def small(self, rows: int = BROADCAST_ROWS) -> DataFrame:
        """For joins against it: with a broadcast hint only when its counted rows and bytes are within the bounds."""
        return F.broadcast(self.df()) if self.bytes() <= BROADCAST_BYTES and self.rows() <= rows else self.df()

    def drop(self) -> None:
        delete_path(self.spark, self.path)


@contextmanager
def scratch() -> Iterator[Callable[[Table], Table]]:
    """Drops the tables written inside it, but for those that ``keep`` hands to the scope around it."""
    mine: list[Table] = []
    kept: list[Table] = []
    Table.scopes.append(mine)

    def keep(t: Table) -> Table:
        kept.append(t)
        return t

    try:
        yield keep
    finally:
        Table.scopes.pop()
        for t in mine:
            if not any(t is k for k in kept):
                t.drop()
        if Table.scopes:
            Table.scopes[-1].extend(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """Bytes of a text; null is empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def id_key(col: str | Column) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def real_id(col: str | Column) -> Column:
    """The id behind an id_key."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def word_count(text: Column) -> Column:
    """Number of words of a text, natively: runs outside the six separators."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")
