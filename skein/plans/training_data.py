"""Queries of the general training-data problems: drift (1), instants (2) and units (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.dates import ntz_seconds
from skein.operators import drift, instants, pay
from skein.session import materialise
from skein.sources.jsonlines import parse_lines
from skein.sources.tables import table

#: Keys of the exports' first files and the columns of the one consistent table they belong to.
COLUMNS = {
    "boss_jobs": {
        "岗位ID": "posting_id", "岗位名称": "title", "公司名称": "company", "行业": "industry", "工作城市": "city", "薪资范围": "salary",
        "工作经验": "experience", "学历要求": "education", "岗位描述": "description", "发布时间": "published_at", "职位链接": "url",
    },
    "liepin_jobs": {
        "position_id": "posting_id", "position_name": "title", "company_name": "company", "location": "city", "salary": "salary",
        "experience": "experience", "education": "education", "job_description": "description", "published_at": "published_at", "job_url": "url",
    },
    "lagou_jobs": {
        "job_id": "posting_id", "job_name": "title", "company_name": "company", "city": "city", "salary_desc": "salary",
        "experience": "experience", "education": "education", "description": "description", "update_time": "published_at", "job_url": "url",
    },
}
KINDS = {"published_at": "timestamp"}
TARGETS = {t: {k: (c, KINDS.get(c, "text")) for k, c in m.items()} for t, m in COLUMNS.items()}


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the three exports in one table."""
    cols = ["row_id", "account_id", "file_no", "file_name", "line_number", "raw_line"]
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), *cols) for t in TARGETS]
    return each[0].unionByName(each[1]).unionByName(each[2])


def ingested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(drift.ingest(export_lines(spark, sf_dir), TARGETS), "ingested")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = drift.drift(ingested_lines(spark, sf_dir))
    return changes.select("table_name", "file_name", "change_kind", "old_field", "new_field")


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = ingested_lines(spark, sf_dir)
    zones = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "row_id", F.col("site_zone").alias("zone")) for t in TARGETS]
    return drift.replay(ingested, drift.promotions(drift.drift(ingested), TARGETS), TARGETS, zones[0].unionByName(zones[1]).unionByName(zones[2]))


def lagou_values(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(row_id, site_zone, received_at, value) of one key of the readable lagou_jobs lines."""
    rows = parse_lines(table(spark, sf_dir, "lagou_jobs"), "raw_line", ["row_id", "site_zone", "received_at"]).where("readable")
    return rows.select("row_id", "site_zone", "received_at", F.expr(f"try_variant_get(obj, '$.{key}', 'string')").alias("value"))


def feishu_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per post of every fetched page."""
    pages = table(spark, sf_dir, "feishu_list")
    return pages.select("page_id", "tenant_id", "fetched_at", "site_zone", F.explode("data.job_post_list").alias("post"))


def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, value, site_zone, clock, seen) of the four tables; ``seen`` in epoch seconds."""
    ntz = lambda c: ntz_seconds(F.col(c))
    iso = F.unix_seconds(F.try_to_timestamp("collected_at"))
    row = lambda d, t, key, value, clock, seen: d.select(
        F.lit(t).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(value).alias("value"), "site_zone",
        F.concat_ws("/", F.lit(t), F.col(clock)).alias("clock"), seen.alias("seen"),
    )
    jobs = row(table(spark, sf_dir, "jobs"), "jobs", "row_id", "published_at", "site_zone", iso)
    lagou = row(lagou_values(spark, sf_dir, "update_time"), "lagou_jobs", "row_id", "value", "site_zone", ntz("received_at"))
    beisen = row(table(spark, sf_dir, "beisen_list"), "beisen_list", "row_id", "PostDate", "tenant_id", ntz("fetched_at"))
    posts = feishu_posts(spark, sf_dir).select("page_id", "tenant_id", "fetched_at", "site_zone", "post.id", "post.publish_time").where("id IS NOT NULL")
    first = posts.groupBy("id").agg(F.min_by(F.struct("publish_time", "site_zone", "tenant_id", "fetched_at"), F.struct(F.col("publish_time").isNull(), "page_id")).alias("p")).select("id", "p.*")
    feishu = row(first, "feishu_list", "id", "publish_time", "tenant_id", ntz("fetched_at"))
    return jobs.unionByName(lagou).unionByName(beisen).unionByName(feishu)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = instants.instants_of(stated_times(spark, sf_dir), "value", "site_zone", "clock", "seen")
    return found.where("epoch_ms IS NOT NULL").select("table_name", "row_key", "epoch_ms")


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone estimated for each stated zone's clocks with the zone hidden, beside the stated one; null where the rows do not tell."""
    rows = stated_times(spark, sf_dir).where("seen IS NOT NULL AND site_zone IS NOT NULL")
    hidden = rows.select(F.concat_ws("|", "table_name", "site_zone").alias("clock"), "value", "seen")
    return instants.estimate_zones(hidden, "value", "seen", "clock")


def pay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, value, low, high, unit, other, category) of the three tables."""
    none = lambda kind: F.lit(None).cast(kind)
    jobs = table(spark, sf_dir, "jobs").select(
        F.lit("jobs").alias("table_name"), F.col("row_id").cast("string").alias("row_key"), F.col("salary_range").alias("value"),
        none("double").alias("low"), none("double").alias("high"), none("string").alias("unit"), F.array(F.col("job_description_raw"), F.col("job_title_raw")).alias("other"),
        F.col("job_family_id").alias("category"),
    )
    rows = parse_lines(table(spark, sf_dir, "lagou_jobs"), "raw_line", ["row_id"]).where("readable")
    text = F.expr("try_variant_get(obj, '$.salary_desc', 'string')")
    lagou = rows.select(
        F.lit("lagou_jobs").alias("table_name"), F.col("row_id").cast("string").alias("row_key"), text.alias("value"),
        none("double").alias("low"), none("double").alias("high"), none("string").alias("unit"), F.array(F.to_json("obj")).alias("other"),
        F.expr("try_variant_get(obj, '$.education', 'string')").alias("category"),
    )
    posts = table(spark, sf_dir, "jobs_list").select("page_id", F.explode("data.list").alias("x")).where("x.jobId IS NOT NULL")
    first = posts.groupBy("x.jobId").agg(
        F.min_by("x", F.struct(F.col("x.lowMonthPay").isNull() & F.col("x.highMonthPay").isNull(), "page_id")).alias("x")
    )
    listed = first.select(
        F.lit("jobs_list").alias("table_name"), F.col("x.jobId").alias("row_key"), none("string").alias("value"), F.col("x.lowMonthPay").alias("low"),
        F.col("x.highMonthPay").alias("high"), F.col("x.payUnit").alias("unit"), F.array_append(F.col("x.recTags"), F.col("x.jobName")).alias("other"), F.col("x.degreeName").alias("category"),
    )
    return jobs.unionByName(lagou).unionByName(listed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pay.to_monthly(pay_records(spark, sf_dir), table(spark, sf_dir, "pay_unit"))
    return done.where("decision = 'converted'").select("table_name", "row_key", "low_yuan", "high_yuan")


def p5_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare figures for a person to look at: those left unconverted, and those whose words and forest disagree or where the forest is unsure."""
    done = pay.to_monthly(pay_records(spark, sf_dir), table(spark, sf_dir, "pay_unit"))
    return done.where("decision = 'review' OR decided_by = 'text'").select("table_name", "row_key", "decision", "low", "high", "predicted", "confidence", "said")


def p5_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pay.held_out(pay_records(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p2_found": p2_found, "p2_zones": p2_zones, "p5_found": p5_found, "p5_review": p5_review, "p5_accuracy": p5_accuracy}
ORACLE: dict[str, str] = {}
