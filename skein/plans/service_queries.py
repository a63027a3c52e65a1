"""Checks of sources, pages and evidence, what changed last, what to collect and to learn, and streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import allocation, profiles
from skein.plans import profile_queries
from skein.session import shared_dir
from skein.sources import adapters
from skein.sources.jsonlines import parse_lines
from skein.sources.tables import table

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_HOST = "rtrim(lower(regexp_extract(source_url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.')"


@query(f"""WITH r AS (SELECT source_name, any_value(source_type) AS kind, any_value(source_domain) AS domain FROM job_source GROUP BY source_name HAVING count(*) = 1), x AS (SELECT row_id, j.source_type AS kind, {_HOST} AS host, r.kind AS want, r.domain, r.source_name IS NULL AS unknown FROM jobs j LEFT JOIN r USING (source_name)),
 m AS (SELECT row_id, list_filter([CASE WHEN unknown THEN 'source_name' END, CASE WHEN NOT unknown AND kind IS DISTINCT FROM want THEN 'source_type' END, CASE WHEN NOT unknown AND NOT coalesce(host = domain OR ends_with(host, '.' || domain), false) THEN 'source_url' END], lambda c: c IS NOT NULL) AS wrong FROM x)
 SELECT row_id, array_to_string(wrong, ',') AS mismatches FROM m WHERE len(wrong) > 0""")
def provenance_mismatch(s, d):
    """The columns in which a row differs from the register of sources."""
    r = table(s, d, "job_source").groupBy("source_name").agg(F.max("source_type").alias("want"), F.max("source_domain").alias("domain"), F.count("*").alias("n")).where("n = 1").withColumn("known", F.lit(True))
    j = table(s, d, "jobs").select("row_id", "source_name", F.col("source_type").alias("kind"), F.rtrim(F.lower(F.regexp_extract("source_url", "^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(".")).alias("host"))
    x = j.join(r, "source_name", "left")
    known = F.coalesce("known", F.lit(False))
    under = F.coalesce((F.col("host") == F.col("domain")) | F.endswith("host", F.concat(F.lit("."), "domain")), F.lit(False))
    wrong = F.array_compact(F.array(F.when(~known, "source_name"), F.when(known & ~F.col("kind").eqNullSafe(F.col("want")), "source_type"), F.when(known & ~under, "source_url")))
    return x.select("row_id", F.array_join(wrong, ",").alias("mismatches")).where("mismatches <> ''")


_FORBIDDEN = "url|link|contact|phone|password|token|公司"


@query(f"""WITH k AS (SELECT row_id, unnest(json_keys(raw_line)) AS key FROM boss_jobs WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' ELSE false END) SELECT key, count(*) AS lines, min(row_id) AS first_row FROM k WHERE regexp_matches(lower(key), '{_FORBIDDEN}') GROUP BY key""")
def forbidden_keys(s, d):
    """Keys of exported lines that name what must not be stored."""
    p = parse_lines(table(s, d, "boss_jobs"), "raw_line", ["row_id"]).where("readable")
    k = p.select("row_id", F.explode(F.expr("map_keys(CAST(obj AS MAP<STRING, VARIANT>))")).alias("key")).where(F.lower("key").rlike(_FORBIDDEN))
    return k.groupBy("key").agg(F.count("*").alias("lines"), F.min("row_id").alias("first_row"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '验证码|captcha|请登录|access denied') AND length(text) <= 8000 THEN 'gate' WHEN length(text) <= 40 AND NOT regexp_matches(text, '岗位|职责|要求|招聘|工程师') THEN 'short' WHEN regexp_matches(text, '<[a-zA-Z/][^<>]*>') THEN 'markup' ELSE 'page' END AS kind FROM documents WHERE text IS NOT NULL""")
def page_kinds(s, d):
    """Pages that stand before content, pages too short to be one, pages with markup, and the others."""
    t = F.col("text")
    gate = F.lower(t).rlike("验证码|captcha|请登录|access denied") & (F.length(t) <= 8000)
    kind = F.when(gate, "gate").when((F.length(t) <= 40) & ~t.rlike("岗位|职责|要求|招聘|工程师"), "short").when(t.rlike("<[a-zA-Z/][^<>]*>"), "markup").otherwise("page")
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", kind.alias("kind"))


_CJK = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))"


@query(f"""WITH e AS (SELECT doc_id, text, {_CJK} AS cjk, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents WHERE doc_kind = 'evidence' AND text IS NOT NULL)
 SELECT doc_id, cjk, array_to_string(list_filter([CASE WHEN cjk < 60 THEN 'too_short' WHEN cjk > 200 THEN 'too_long' END, CASE WHEN copies > 1 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS issues FROM e""")
def evidence_checks(s, d):
    """Pieces of evidence by length in Chinese characters and whether they are unique."""
    e = table(s, d, "documents").where("doc_kind = 'evidence' AND text IS NOT NULL").select("doc_id", F.md5("text").alias("h"), F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]")).cast("bigint").alias("cjk"))
    n = e.groupBy("h").agg(F.count("*").alias("copies"))
    issues = F.array_compact(F.array(F.when(F.col("cjk") < 60, "too_short").when(F.col("cjk") > 200, "too_long"), F.when(F.col("copies") > 1, "repeated")))
    return e.join(n, "h").select("doc_id", "cjk", F.array_join(issues, ",").alias("issues"))


@query(profile_queries.P + profile_queries.EVOLVED + """, x AS (SELECT family, max(qi) AS qi FROM c WHERE change <> 'none' GROUP BY family)
 SELECT c.family, c.qi, change, count(*) AS n, count(DISTINCT skill) AS skills, sum(ev_before + ev_after)::BIGINT AS evidence FROM c JOIN x ON c.family = x.family AND c.qi = x.qi WHERE change <> 'none' GROUP BY ALL""")
def evolution_latest(s, d):
    """Per family what changed in the last period that changed anything, by kind, with the records behind it."""
    c = profile_queries._evolved(s, d).where("change <> 'none'")
    w = Window.partitionBy("family")
    g = c.groupBy("family", "qi", "change").agg(F.count("*").alias("n"), F.count_distinct("skill").alias("skills"), F.sum(F.col("ev_before") + F.col("ev_after")).alias("evidence"))
    return g.withColumn("last", F.max("qi").over(w)).where("qi = last").drop("last")  # families and periods, no records


@query(profile_queries.P + profile_queries.RATES + """, ev AS (SELECT family, level, qi, skill FROM r WHERE rate >= 0.15), sl AS (SELECT family, level, qi, count(*) AS n FROM p GROUP BY ALL)
 SELECT ev.family, ev.level, ev.qi, ev.skill, a.n AS n_before, b.n AS n_after, CASE WHEN coalesce(a.n, 0) >= 20 AND coalesce(b.n, 0) >= 20 THEN 'formal' ELSE 'demoted' END AS standing FROM ev
 LEFT JOIN sl a ON a.family = ev.family AND a.level = ev.level AND a.qi = ev.qi - 1 LEFT JOIN sl b ON b.family = ev.family AND b.level = ev.level AND b.qi = ev.qi""")
def event_standing(s, d):
    """Events beside the profile before and the profile after them; one whose sides are not both ready is demoted."""
    r = profile_queries.postings(s, d)
    ev = profiles.prevalence(r, profile_queries.links(s, d), ["family", "level", "qi"], "o_orderkey", "skill").where("rate >= 0.15").select("family", "level", "qi", "skill")
    sl = r.groupBy("family", "level", "qi").agg(F.count("*").alias("n"))
    before, after = sl.select("family", "level", (F.col("qi") + 1).alias("qi"), F.col("n").alias("n_before")), sl.withColumnRenamed("n", "n_after")
    x = ev.join(before, ["family", "level", "qi"], "left").join(after, ["family", "level", "qi"], "left")
    formal = (F.coalesce("n_before", F.lit(0)) >= 20) & (F.coalesce("n_after", F.lit(0)) >= 20)
    return x.select("family", "level", "qi", "skill", "n_before", "n_after", F.when(formal, "formal").otherwise("demoted").alias("standing"))


@query("""WITH b AS (SELECT 'beisen' AS source, tenant_id || '/' || JobAdId AS identity, JobAdName AS title, array_to_string(LocNames, ', ') AS places FROM beisen_list), f AS (SELECT 'feishu' AS source, tenant_id || '/' || x.id AS identity, x.title AS title, array_to_string(list_transform(x.city_list, lambda c: c.name), ', ') AS places FROM (SELECT tenant_id, unnest(data.job_post_list) AS x FROM feishu_list)),
 u AS (FROM b UNION ALL FROM f) SELECT source, count(*) AS n, count(DISTINCT identity) AS identities, count(title) AS titled, count(nullif(places, '')) AS placed FROM u GROUP BY source""")
def source_postings(s, d):
    """What each source delivers, all through one interface."""
    # A null identifier leaves no identity, as in SQL's concatenation.
    a = adapters.all_postings(s, d)
    identity = F.when(F.col("identity").contains("/"), F.col("identity"))
    return a.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(identity).alias("identities"), F.count("title").alias("titled"), F.count(F.nullif("places", F.lit(""))).alias("placed"))


@query()
def collection_batch(s, d):
    """The next 200 records to collect, by family and source: what lacks most first, no source beyond a third of all."""
    j = table(s, d, "jobs")
    have = j.groupBy("job_family_id").agg(F.count("*").alias("n"))
    want = table(s, d, "job_family").select("job_family_id").join(have, "job_family_id", "left").fillna(0)  # a fixed list of 20
    needs = [allocation.Need(r["job_family_id"], max(0, 5000 - r["n"])) for r in want.orderBy("job_family_id").collect()]
    names = table(s, d, "job_source").select("source_name").distinct()  # a fixed list of 32
    held = {r["source_name"]: r["n"] for r in j.groupBy("source_name").agg(F.count("*").alias("n")).join(names, "source_name").collect()}
    caps = {r["source_name"]: 50 for r in names.orderBy("source_name").collect()}
    picks = allocation.allocate(needs, held, caps, 200, 0.35)
    return s.createDataFrame(picks, "family string, source string").groupBy("family", "source").agg(F.count("*").alias("planned"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Events per day and type by a stream with windows. State is kept for all windows, as late rows count."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    counts = rows.withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    out = counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows")

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/rows")


@query("SELECT event_type, count(DISTINCT (user_id, event_type, round(value, 2)::DECIMAL(18,2))) AS revisions FROM events GROUP BY event_type")
def stream_revisions(s: SparkSession, d: str) -> DataFrame:
    """Distinct contents by a stream that keeps what it has seen in its state, so a repeated delivery adds nothing."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    once = rows.select("user_id", "event_type", F.round("value", 2).cast("decimal(18,2)").alias("value")).dropDuplicates(["user_id", "event_type", "value"])
    once.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("user_id bigint, event_type string, value decimal(18,2)").parquet(f"{base}/rows").groupBy("event_type").agg(F.count("*").alias("revisions"))


QUERIES, ORACLE = Q, O
