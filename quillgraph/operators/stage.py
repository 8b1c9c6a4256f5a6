"""Written stages: iterative operators cut their lineage by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a counted table up to which a broadcast is asked for.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, a temporary folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="quillgraph-")
        root = "file://" + shared_dir.own
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows, read back from a table written in the shared folder; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if a count, of a written table, is within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bytes of input files, a few hundred thousand rows, that one part of a dealt table may hold.
PART_BYTES = 2 << 20


#: Bytes of input files up to which Spark's own exchanges are left as they are.
PLAIN_BYTES = 48 << 20


def part_count(df: DataFrame) -> int | None:
    """Parts of bounded size for the rows of the files that a table reads; None where these are few."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in set(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return None if total <= PLAIN_BYTES else max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys, before a group or join by them, into parts whose number grows with the input.

    Grouping then happens once, behind the exchange, and no task holds more than a part; an exchange that Spark
    plans itself has parts of a fixed compressed size, and groups a whole split of the files before it.
    """
    n = part_count(df)
    return df.repartition(n, *keys) if n else df
