"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import canonical, capping, history, leaks, names, sentences, tokens
from skein.session import materialise
from skein.sources.jsonlines import parse_lines
from skein.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("row_id", "batch_no", "record_id", F.col("job_description_raw").alias("description"))
    return history.repeats(jobs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["row_id", "batch_no", "job_family_id", "source_name", "source_url", "quality_score"]
    jobs = table(spark, sf_dir, "jobs").select(*cols)
    families = table(spark, sf_dir, "job_family")
    meant = canonical.match(jobs.select(F.col("job_family_id").alias("value")), surfaces(spark, sf_dir)["job_family_id"])
    meant = meant.where("ref_id <> 'NONE'").join(families.select(F.col("job_family_id").alias("ref_id"), "max_rows"), "ref_id")
    rows = capping.operators(jobs, table(spark, sf_dir, "job_source")).join(meant.withColumnRenamed("value", "job_family_id"), "job_family_id")
    rows = rows.where("operator IS NOT NULL").select(
        "row_id", F.concat_ws("|", "batch_no", "operator", "ref_id").alias("contributor"), F.col("max_rows").alias("cap"), F.col("quality_score").alias("score")
    )
    return capping.surplus(rows).select("row_id")


def surfaces(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Per field of jobs the accepted spellings of the entries of its reference list."""

    def of(name: str, key: str, *columns) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias("ref_id"), F.explode(F.array(*columns)).alias("surface"))

    return {
        "job_title_raw": of("job_title", "title_id", "title", "title_en"),
        "job_family_id": of("job_family", "job_family_id", "job_family_id", "family_name", "legacy_code"),
        "region": of("city", "city_id", "city", "city_latin", "short_code"),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs")
    places = table(spark, sf_dir, "city").select("city", "province").collect()  # a fixed list of 30
    around = {"job_title_raw": sorted({r["city"] for r in places}), "region": sorted({r["province"] for r in places})}
    mapped = None
    for field, reference in surfaces(spark, sf_dir).items():
        m = materialise(canonical.match(
            jobs.select(F.col(field).alias("value")), reference, "place" if field == "region" else "text", around.get(field)
        ).select(F.lit(field).alias("field"), "value", "ref_id"), "mapped")
        mapped = m if mapped is None else mapped.unionByName(m)
    typed = jobs.select("row_id", F.explode(F.create_map(*[x for f in surfaces(spark, sf_dir) for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    return typed.where("value IS NOT NULL").join(mapped, ["field", "value"]).select("row_id", "field", "ref_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "passage"))
    return found.select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse_lines(table(spark, sf_dir, "liepin_jobs"), "raw_line", ["row_id"]).where("readable")
    text = F.expr("CASE WHEN schema_of_variant(try_variant_get(obj, '$.company_name', 'variant')) = 'STRING' THEN try_variant_get(obj, '$.company_name', 'string') END")
    typed = table(spark, sf_dir, "jobs").select(F.col("company_name").alias("name")).unionByName(lines.select(text.alias("name")))
    places = {}
    for r in table(spark, sf_dir, "city").select("city", "city_latin").collect():  # a fixed list of 30
        places |= {r["city"]: r["city"], "".join(c for c in r["city_latin"].lower() if c.isalpha()): r["city"]}
    return names.pairs(names.resolve(typed, places))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.segment(table(spark, sf_dir, "documents"), "doc_id", "text")


def p3_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats by record identifier alone: the index over rows without descriptions."""
    jobs = table(spark, sf_dir, "jobs").select("row_id", "batch_no", "record_id", F.lit(None).cast("string").alias("description"))
    return history.repeats(jobs)


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids decode to."""
    return tokens.decode(p8_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("h"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p3_by_record": p3_by_record, "p8_decoded": p8_decoded}
ORACLE: dict[str, str] = {
    "p3_by_record": """WITH r AS (SELECT row_id, nullif(trim(record_id, ' '), '') AS record_id FROM jobs), f AS (SELECT row_id, min(row_id) OVER (PARTITION BY record_id) AS first FROM r WHERE record_id IS NOT NULL)
 SELECT first AS row_id_a, row_id AS row_id_b FROM f WHERE first < row_id""",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents",
}
