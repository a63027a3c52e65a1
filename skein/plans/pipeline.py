"""The whole chain as one run: duplicates, findings, profiles, changes, chunks, targets, each stage written before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import sinks

STAGES = ["dup_master", "quality_gate", "quarterly_profiles", "adjacent_evolution", "chunk_refresh", "target_status"]


def signature(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows: counts and sums of row hashes."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(text, F.lit(1))).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


def run(spark: SparkSession, sf_dir: str, out: str, at: str, stages: list[str] | None = None) -> dict[str, str]:
    """Write each stage's table under ``out`` with a line in the ledger; the signature of each. A stage that fails is recorded as such and ends
    the run, and what was in force before stays. ``at`` is the run's time, given by the caller."""
    from skein.plans import registry

    run_id, found = uuid.uuid4().hex, {}
    for stage in stages or STAGES:
        try:
            path = f"{out}/{run_id}/{stage}"
            registry.QUERIES[stage](spark, sf_dir).write.mode("overwrite").parquet(path)
            done = spark.read.parquet(path)
            found[stage] = signature(done)
            sinks.record_run(spark, f"{out}/runs", run_id, stage, "done", done.count(), at)
        except Exception:
            sinks.record_run(spark, f"{out}/runs", run_id, stage, "failed", 0, at)
            raise
    return found
