"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators import profiles
from skein.plans import field_queries, matching_queries, profile_queries, record_queries, service_queries, training_data

MODULES = [profile_queries, record_queries, field_queries, matching_queries, service_queries, training_data]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by (segment, quarter), the coarse form that has ready slices in the smallest data too."""
    records = profile_queries.postings(spark, sf_dir)
    return profiles.slices(records, ["family", "period"], "o_orderkey", "o_totalprice", "o_orderdate")
