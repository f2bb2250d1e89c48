"""Statistical files as streams: new files of a folder in, one file a micro-batch out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..api import write
from ..sources import datasource as ds


def read_stream(spark: SparkSession, folder: str, fmt: str, **options) -> DataFrame:
    """A stream of the rows of a folder's files of one format, oldest file first; the first file gives the schema."""
    ds.register(spark)
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark.readStream.format(fmt).options(**options).load(folder)


def write_stream(df: DataFrame, folder: str, fmt: str, checkpoint: str, **kwargs):
    """Start a query that writes each micro-batch to a file of its own, named by its number, so that a batch that is run
    again replaces its file."""
    os.makedirs(folder, exist_ok=True)

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, os.path.join(folder, f"batch-{number:08d}.{fmt}"), **kwargs)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
