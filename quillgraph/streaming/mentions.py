"""Mentions of documents as they land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.extract import mention_aggregates, regex_entities
from quillgraph.sources.files import DOCUMENTS


def landing(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of document JSON lines."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def mention_stream(docs: DataFrame, out: str, checkpoint: str, key: str = "url"):
    """Writes each batch's mention rows; a document is in one batch, so its counts are whole.

    A batch's rows go to a folder of the batch's number and replace what a failed attempt left there.
    """

    def write(batch: DataFrame, number: int) -> None:
        mention_aggregates(regex_entities(batch, key)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
