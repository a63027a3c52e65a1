"""Observations as a stream: the latest per key, with late rows counted and never dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_dir


def latest_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, seen) by a file stream over events, run until it has read all there is.

    Each micro-batch is pre-aggregated and appended under its own batch number, so a batch that is
    replayed after a failure overwrites itself; the state is the table of these partial rows.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")

    def upsert(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("seen"))
        part.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    job = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("user_id").agg(F.max("ts").alias("ts"), F.sum("seen").alias("seen"))
