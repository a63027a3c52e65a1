"""Sources of postings behind one interface, so a new vendor is a class and no change elsewhere."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

#: What every source delivers.
POSTING = ["source_row", "identity", "title", "places", "text", "published", "fetched_at", "site_zone"]


class Source(ABC):
    """A source names itself and lists its postings; fetching is not its business."""

    name: str

    @abstractmethod
    def postings(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """POSTING rows."""


class BeisenSource(Source):
    """One ad per row, places in an array, days as text."""

    name = "beisen"

    def postings(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        b = table(spark, sf_dir, "beisen_list")
        return b.select(F.col("row_id").alias("source_row"), F.concat_ws("/", "tenant_id", "JobAdId").alias("identity"), F.col("JobAdName").alias("title"), F.array_join("LocNames", ", ").alias("places"),
                        F.col("Duty").alias("text"), F.col("PostDate").alias("published"), "fetched_at", "site_zone")


class FeishuSource(Source):
    """Pages of posts, places as structures, text in two parts; failed pages have none."""

    name = "feishu"

    def postings(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "feishu_list").select("page_id", "tenant_id", "fetched_at", "site_zone", F.explode("data.job_post_list").alias("x"))
        return p.select(F.col("page_id").alias("source_row"), F.concat_ws("/", "tenant_id", "x.id").alias("identity"), F.col("x.title").alias("title"), F.array_join("x.city_list.name", ", ").alias("places"),
                        F.concat_ws("\n", "x.description", "x.requirement").alias("text"), F.col("x.publish_time").alias("published"), "fetched_at", "site_zone")


SOURCES: dict[str, Source] = {s.name: s for s in (BeisenSource(), FeishuSource())}


def all_postings(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """The postings of the named sources, or of all, with ``source``."""
    out = None
    for n in names or sorted(SOURCES):
        d = SOURCES[n].postings(spark, sf_dir).select(F.lit(n).alias("source"), *POSTING)
        out = d if out is None else out.unionByName(d)
    return out
