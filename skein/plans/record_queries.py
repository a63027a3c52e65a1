"""Ingestion, text, observation, retrieval and window queries over postings, documents and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.dates import ntz_seconds
from skein.functions import fields
from skein.functions.text import without_contacts
from skein.operators import instants, profiles, resume, retrieval
from skein.session import materialise
from skein.sources.jsonlines import parse_lines
from skein.sources.tables import table
from skein.streaming.observations import latest_by_stream

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


FILLED = ("company_name", "industry", "region", "published_at", "experience_requirement", "education_requirement", "salary_range", "source_url")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


@query("""WITH x AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g'), '和及与', '') AS w FROM documents WHERE text IS NOT NULL) SELECT sha256(w) AS h, count(*) AS copies, min(doc_id) AS first_id FROM x WHERE w <> '' GROUP BY w HAVING count(*) > 1""")
def content_hash_dups(s, d):
    """Texts of equal wording; texts without any letter or digit have none."""
    w = fields.wording(F.col("text"))
    x = docs(s, d).where("text IS NOT NULL").select("doc_id", w.alias("w")).where("w <> ''")
    return x.groupBy(F.sha2("w", 256).alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""WITH x AS (SELECT row_id, record_id, quality_score, length(job_description_raw) AS n FROM jobs), f AS (SELECT record_id, max_by(row_id, (coalesce(quality_score, -1), n, -row_id)) AS master, count(*) AS copies FROM x WHERE record_id IS NOT NULL GROUP BY record_id HAVING count(*) > 1)
 SELECT x.row_id, f.master, copies FROM x JOIN f USING (record_id) WHERE x.row_id <> f.master""")
def dup_master(s, d):
    x = table(s, d, "jobs").select("row_id", "record_id", F.struct(F.coalesce("quality_score", F.lit(-1.0)), F.length("job_description_raw"), -F.col("row_id")).alias("worth"))
    x = x.where("record_id IS NOT NULL")
    f = x.groupBy("record_id").agg(F.max_by("row_id", "worth").alias("master"), F.count("*").alias("copies")).where("copies > 1")
    return x.join(f, "record_id").where("row_id <> master").select("row_id", "master", "copies")


#: The instant that checks of the future are made at; no plan reads a clock.
NOW = "2026-01-01 00:00:00"
_STAMP = "^\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?(?:Z|[+-]\\d{2}:\\d{2})?)?$"
_NEEDED = {"record_id": "missing_record_id", "job_family_id": "missing_job_family", "job_title_raw": "missing_job_title", "source_name": "missing_source_name", "collected_at": "missing_collected_at", "job_description_raw": "missing_job_description"}
_HARD = [*_NEEDED.values(), "job_description_too_short", "invalid_published_at", "invalid_collected_at"]


def _stamp_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_STAMP}') THEN try_cast(replace(regexp_replace({c}, '(?:Z|[+-]\\d{{2}}:\\d{{2}})$', ''), 'T', ' ') AS TIMESTAMP) END"


_CHECKS = ", ".join([
    *[f"CASE WHEN coalesce({c}, '') = '' THEN '{code}' END" for c, code in _NEEDED.items()],
    "CASE WHEN job_description_raw <> '' AND length(regexp_replace(job_description_raw, '[^\\p{L}\\p{N}]+', '', 'g')) < 40 THEN 'job_description_too_short' END",
    "CASE WHEN published_at <> '' AND p IS NULL THEN 'invalid_published_at' END", "CASE WHEN collected_at <> '' AND c IS NULL THEN 'invalid_collected_at' END",
    "CASE WHEN p > c + INTERVAL 1 DAY THEN 'published_after_collection' END", "CASE WHEN abs(floor((epoch_us(c) - epoch_us(p)) / 86400000000.0)) > 3653 THEN 'published_collection_gap_too_large' END",
    f"CASE WHEN p > TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN 'future_published_at' END",
    "CASE WHEN trim(coalesce(source_url, '')) = '' THEN 'missing_source_url' WHEN NOT regexp_matches(trim(source_url), '^(?i:https?)://[^/?#]+') THEN 'invalid_source_url' END",
    "CASE WHEN coalesce(quality_score, 0) < 0.7 THEN 'low_quality_score' END",
])
GATED = f"WITH s AS (SELECT *, {_stamp_sql('published_at')} AS p, {_stamp_sql('collected_at')} AS c FROM jobs), g AS (SELECT row_id, batch_no, list_sort(list_filter([{_CHECKS}], lambda x: x IS NOT NULL)) AS issues FROM s)"


def _gated(s, d):
    """The findings of each row: what is missing, too short, no time, out of order or not an address."""
    stamp = lambda c: F.when(F.col(c).rlike(_STAMP), F.expr(f"try_cast(replace(regexp_replace({c}, '(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})$', ''), 'T', ' ') AS timestamp_ntz)"))
    j = table(s, d, "jobs").select("*", stamp("published_at").alias("p"), stamp("collected_at").alias("c"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    address = F.trim("source_url")
    gap = F.floor((ntz_seconds(F.col("c")) - ntz_seconds(F.col("p"))) / 86400)
    issues = F.array(
        *[F.when(blank(c), code) for c, code in _NEEDED.items()],
        F.when((F.col("job_description_raw") != "") & (F.length(F.regexp_replace("job_description_raw", r"[^\p{L}\p{N}]+", "")) < 40), "job_description_too_short"),
        F.when((F.col("published_at") != "") & F.col("p").isNull(), "invalid_published_at"), F.when((F.col("collected_at") != "") & F.col("c").isNull(), "invalid_collected_at"),
        F.when(F.col("p") > F.col("c") + F.expr("INTERVAL '1' DAY"), "published_after_collection"), F.when(F.abs(gap) > 3653, "published_collection_gap_too_large"),
        F.when(F.col("p") > F.expr(f"TIMESTAMP_NTZ '{NOW}' + INTERVAL '1' DAY"), "future_published_at"),
        F.when(blank(address), "missing_source_url").when(~address.rlike(r"^(?i:https?)://[^/?#]+"), "invalid_source_url"), F.when(F.coalesce("quality_score", F.lit(0.0)) < 0.7, "low_quality_score"),
    )
    return j.select("row_id", "batch_no", F.array_sort(F.array_compact(issues)).alias("issues"))


@query(GATED + f" SELECT row_id, array_to_string(issues, ',') AS issues, CASE WHEN list_has_any(issues, {_HARD}) THEN 'quarantined' WHEN len(issues) > 0 THEN 'review' ELSE 'valid' END AS status FROM g")
def quality_gate(s, d):
    hard = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in _HARD]))
    return _gated(s, d).select("row_id", F.array_join("issues", ",").alias("issues"), F.when(hard, "quarantined").when(F.size("issues") > 0, "review").otherwise("valid").alias("status"))


@query(GATED + " SELECT issue, count(*) AS n, count(DISTINCT batch_no) AS batches FROM (SELECT batch_no, unnest(issues) AS issue FROM g) GROUP BY issue")
def gate_issue_counts(s, d):
    return _gated(s, d).select("batch_no", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("batch_no").alias("batches"))


# How far a kind of source is trusted.
SOURCE_SCORES = {
    "company_official": 0.95, "occupation_standard": 1.0, "technical_standard": 0.98, "policy_document": 0.95, "official_document": 0.92, "public_recruitment": 0.85,
    "university_recruitment": 0.8, "authorized_platform": 0.8, "open_dataset": 0.75, "public": 0.7,
}
_COMPLETE = ("company_name", "industry", "region", "published_at", "experience_requirement", "education_requirement")


@query("SELECT row_id, round(0.45 * CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_SCORES.items()) + " ELSE 0.65 END + 0.30 * (" + " + ".join(f"(coalesce({c}, '') <> '')::INT" for c in _COMPLETE) + ") / 6 + 0.25 * least(coalesce(length(job_description_raw), 0) / 500, 1), 4) AS score FROM jobs")
def quality_score(s, d):
    scores = F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv])
    filled = reduce(lambda a, b: a + b, [(F.coalesce(c, F.lit("")) != "").cast("int") for c in _COMPLETE])
    size = F.least(F.coalesce(F.length("job_description_raw"), F.lit(0)) / 500, F.lit(1.0))
    return table(s, d, "jobs").select("row_id", F.round(0.45 * F.coalesce(scores[F.col("source_type")], F.lit(0.65)) + 0.30 * filled / 6 + 0.25 * size, 4).alias("score"))


TOKENS = ["feature", "store", "python", "runbook", "监控", "结算网关"]
_SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 + 0.1 * ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}) ELSE 0 END" for t in TOKENS)


@query(f"SELECT doc_id, round({_SCORE}, 4) AS score FROM documents WHERE text IS NOT NULL AND ({_SCORE}) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def lexical_search_topk(s, d):
    scored = docs(s, d).where("text IS NOT NULL").select("doc_id", F.round(retrieval.lexical_score(F.lower("text"), TOKENS), 4).alias("score"))
    return retrieval.top(scored, "score", "doc_id", 50)


@query(f"""WITH c AS (SELECT doc_id, source, doc_kind, round({_SCORE} + CASE WHEN doc_kind = 'evidence' THEN 0.35 ELSE 0.2 END, 4) AS score, md5(text) AS h FROM documents WHERE text IS NOT NULL AND ({_SCORE}) > 0),
 u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, doc_id) AS again FROM c) SELECT doc_id, source, doc_kind, score, 'K' || row_number() OVER (ORDER BY score DESC, (doc_kind = 'evidence') DESC, doc_id) AS cite FROM u WHERE again = 1
 QUALIFY row_number() OVER (ORDER BY score DESC, (doc_kind = 'evidence') DESC, doc_id) <= 12""")
def evidence_merge_topk(s, d):
    base = retrieval.lexical_score(F.lower("text"), TOKENS)
    c = docs(s, d).where("text IS NOT NULL").withColumn("base", base).where("base > 0")
    c = c.select("doc_id", "source", "doc_kind", F.round(F.col("base") + F.when(F.col("doc_kind") == "evidence", 0.35).otherwise(0.2), 4).alias("score"), F.md5("text").alias("h"))
    once = profiles.latest(c, ["h"], F.desc("score"), F.asc("doc_id")).drop("h")
    first = once.orderBy(F.desc("score"), F.desc(F.col("doc_kind") == "evidence"), "doc_id").limit(12)
    w = Window.orderBy(F.desc("score"), F.desc(F.col("doc_kind") == "evidence"), "doc_id")  # twelve rows
    return first.withColumn("cite", F.concat(F.lit("K"), F.row_number().over(w).cast("string")))


_COS = "list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q)))"


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query_id, vec_id, round({_COS}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), q WHERE vec_id <> query_id)
 SELECT query_id, vec_id, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def cosine_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.top_cosine(e, q, 5)


_HYBRID = f"coalesce(CASE WHEN text IS NOT NULL THEN {_SCORE} END, 0)"


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, {_COS} AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), q),
 x AS (SELECT doc_id, {_HYBRID} AS lexical, coalesce(cosine, 0) AS cosine FROM documents LEFT JOIN e ON doc_id = vec_id)
 SELECT doc_id, round(lexical + cosine, 6) AS score FROM x WHERE lexical > 0 OR cosine > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def hybrid_topk(s, d):
    """Lexical score plus cosine to the query's vector, that of vec_id 0; a document has the vector of its number, or none."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), retrieval.cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    x = docs(s, d).select("doc_id", F.coalesce(retrieval.lexical_score(F.lower("text"), TOKENS), F.lit(0.0)).alias("lexical")).join(scored, "doc_id", "left").fillna({"cosine": 0.0})
    x = x.where("lexical > 0 OR cosine > 0").select("doc_id", F.round(F.col("lexical") + F.col("cosine"), 6).alias("score"))
    return x.orderBy(F.desc("score"), "doc_id").limit(50)


def signed_jobs(s: SparkSession, d: str) -> DataFrame:
    """(row_id, family, bits) of the postings with a text; rows without a family are one family."""
    j = table(s, d, "jobs").where("job_description_raw IS NOT NULL")
    family = F.coalesce(F.concat(F.lit("="), "job_family_id"), F.lit(""))
    return j.select("row_id", family.alias("family"), retrieval.simhash64(F.col("job_description_raw")).alias("bits"))


@query()
def text_simhash_pairs(s, d):
    """Pairs of signatures of texts within 8 bits in a family, each named by its first row; equal ones are in text_simhash_clusters."""
    signed = materialise(signed_jobs(s, d), "signed")
    near = retrieval.hamming_pairs(signed, "row_id", "family", "bits")
    return near.select(F.nullif(F.substring("family", 2, 1 << 30), F.lit("")).alias("family"), "a", "b", "distance")


@query()
def text_simhash_clusters(s, d):
    """Every row of a cluster of near or equal texts of a family, with the cluster's master: the best
    by score, filled fields, time of publication and least row. ``first`` names the row's signature in
    text_simhash_pairs."""
    signed = materialise(signed_jobs(s, d), "signed")
    near = materialise(retrieval.hamming_pairs(signed, "row_id", "family", "bits").select("a", "b"), "near")
    roots = retrieval.components(near).select(F.col("key").alias("first"), F.col("first").alias("root"))
    named = signed.join(retrieval.representatives(signed, "row_id", "family", "bits"), ["family", "bits"]).join(roots, "first", "left")
    held = named.select("row_id", "first", F.coalesce("root", "first").alias("root"))
    filled = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) != "").cast("int"), F.lit(0)) for c in FILLED])
    at = instants.to_instants(table(s, d, "jobs").select("row_id", "quality_score", *FILLED, "site_zone"), "published_at", "site_zone")
    worth = F.struct(F.coalesce("quality_score", F.lit(0.0)), filled, F.coalesce("epoch_ms", F.lit(0).cast("bigint")), -F.col("row_id")).alias("worth")
    best = held.join(at.select("row_id", worth), "row_id").groupBy("root").agg(F.max_by("row_id", "worth").alias("master"), F.count("*").alias("members")).where("members > 1")
    return held.join(best, "root").select("row_id", "first", "master", "members")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_observation(s, d):
    return profiles.latest(table(s, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "ts", "event_type")


@query("""WITH x AS (SELECT *, md5(event_type || '|' || value::VARCHAR) AS h FROM (SELECT user_id, event_id, ts, event_type, round(value, 2)::DECIMAL(18,2) AS value FROM events)), u AS (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY ts, event_id) AS again FROM x)
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM u WHERE again = 1""")
def revision_numbers(s, d):
    x = table(s, d, "events").withColumn("h", F.md5(F.concat("event_type", F.lit("|"), F.round("value", 2).cast("decimal(18,2)").cast("string"))))
    once = profiles.latest(x, ["user_id", "h"], F.asc("ts"), F.asc("event_id"))
    return retrieval.rank_within(once, ["user_id"], F.asc("ts"), F.asc("event_id"), name="revision").select("user_id", "event_id", "revision")


@query("SELECT record_id, min(first_seen_at) AS first_seen, max(last_seen_at) AS last_seen, count(*) AS observations FROM jobs GROUP BY record_id")
def first_last_seen(s, d):
    return table(s, d, "jobs").groupBy("record_id").agg(F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count("*").alias("observations"))


@query("""SELECT row_id, floor((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000.0)::BIGINT AS days, CASE WHEN (epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000.0 > 7 THEN 'stale' ELSE 'fresh' END AS age FROM jobs WHERE first_seen_at IS NOT NULL AND last_seen_at IS NOT NULL""")
def observation_gap(s, d):
    days = (ntz_seconds(F.col("last_seen_at")) - ntz_seconds(F.col("first_seen_at"))) / 86400
    return table(s, d, "jobs").where("first_seen_at IS NOT NULL AND last_seen_at IS NOT NULL").select("row_id", F.floor(days).cast("bigint").alias("days"), F.when(days > 7, "stale").otherwise("fresh").alias("age"))


@query("""WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, ts AS seen_at, max(event_id) AS seen_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id, ts)
 SELECT a.user_id, a.event_id, b.seen_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.seen_at""")
def asof_observations(s, d):
    e = table(s, d, "events")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = s.sql("SELECT *, event_type = (SELECT lo FROM {k}) AS left_side, event_type = (SELECT hi FROM {k}) AS right_side FROM {e}", e=e, k=kinds).where("left_side OR right_side")
    # One sort per user instead of a join: the newest right-hand row up to each left-hand row.
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.when(F.col("right_side"), F.struct("ts", "event_id"))).over(w)
    return tagged.withColumn("seen", seen["event_id"]).where("left_side").select("user_id", "event_id", F.col("seen").alias("seen_id"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_daily(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH x AS (SELECT *, epoch(ts)::BIGINT // 43200 AS slot FROM events), w AS (SELECT unnest([slot, slot - 1]) AS start_slot, user_id, value FROM x) SELECT start_slot, count(*) AS n, count(DISTINCT user_id) AS users FROM w GROUP BY start_slot""")
def sliding_day_half(s, d):
    x = table(s, d, "events").select(F.floor(ntz_seconds(F.col("ts")) / 43200).alias("slot"), "user_id")
    w = x.select("user_id", F.explode(F.array("slot", F.col("slot") - 1)).alias("start_slot"))
    return w.groupBy("start_slot").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH x AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x)
 SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM y GROUP BY user_id, session""")
def sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '6' HOUR"), 0).otherwise(1))
    y = e.withColumn("session", F.sum("fresh").over(w))
    return y.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT event_type, CAST(props->>'k' AS INT) AS k, count(*) AS n FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_path_predicate(s, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(s, d, "events").where(k.isNotNull()).groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS a, date_trunc('month', o_orderdate + INTERVAL 75 DAY) AS b FROM orders), m AS (SELECT DISTINCT o_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM r) SELECT o_custkey, count(*) AS months FROM m GROUP BY o_custkey""")
def interval_months(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("a"))
    first, last = F.trunc("a", "month"), F.trunc(F.date_add("a", 75), "month")
    return o.select("o_custkey", F.explode(F.sequence(first, last, F.expr("INTERVAL '1' MONTH"))).alias("month")).distinct().groupBy("o_custkey").agg(F.count("*").alias("months"))


MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{MAIL}', '[email]', 'g'), 'https?://[^\\s，。；]+', '[url]', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def pii_redaction(s, d):
    clean = F.regexp_replace(F.regexp_replace("text", MAIL, "[email]"), r"https?://[^\s，。；]+", "[url]")
    return docs(s, d).where("text IS NOT NULL").select("doc_id", F.md5(clean).alias("h"))


@query()
def contact_redaction(s, d):
    """Texts without contact lines, contact fragments, e-mail addresses and phone numbers."""
    return docs(s, d).where("text IS NOT NULL").select("doc_id", without_contacts(F.col("text")).alias("text"))


_URL = "^(?i:(https?))://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\\d*))?(/[^?#]*)?(?:\\?([^#]*))?(?:#.*)?$"


@query(f"""WITH x AS (SELECT row_id, lower(regexp_extract(source_url, '{_URL}', 1)) AS scheme, lower(regexp_extract(source_url, '{_URL}', 2)) AS host, regexp_extract(source_url, '{_URL}', 3) AS port, regexp_extract(source_url, '{_URL}', 4) AS path,
 list_sort(list_transform(list_filter(string_split(regexp_extract(source_url, '{_URL}', 5), '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS q FROM jobs WHERE regexp_matches(source_url, '{_URL}'))
 SELECT row_id, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || replace(array_to_string(q, '&'), '%20', '+') END AS url FROM x""")
def url_canonical(s, d):
    return table(s, d, "jobs").select("row_id", fields.url(F.col("source_url")).alias("url")).where("url IS NOT NULL")


@query("""WITH x AS (SELECT row_id, rtrim(lower(regexp_extract(source_url, '^(?i:https?)://([^/?#:]+)', 1)), '.') AS host FROM jobs WHERE source_url IS NOT NULL) SELECT row_id, max_by(source_id, length(source_domain)) AS source_id FROM x JOIN job_source ON host = source_domain OR ends_with(host, '.' || source_domain) GROUP BY row_id""")
def domain_allow_list(s, d):
    x = table(s, d, "jobs").select("row_id", F.rtrim(F.lower(F.regexp_extract("source_url", r"^(?i:https?)://([^/?#:]+)", 1)), F.lit(".")).alias("host")).where("host <> ''")
    labels = F.split("host", r"\.")
    hosts = x.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("source_domain"))
    best = hosts.join(table(s, d, "job_source").select("source_domain", "source_id"), "source_domain").groupBy("host").agg(F.max_by("source_id", F.length("source_domain")).alias("source_id"))
    return x.join(best, "host").select("row_id", "source_id")


@query("""SELECT row_id, field, before, after FROM (SELECT row_id, unnest(['region', 'industry', 'salary_range']) AS field, unnest([region, industry, salary_range]) AS before, unnest([nullif(trim(region, ' '), ''), nullif(trim(industry, ' '), ''), nullif(trim(salary_range, ' '), '')]) AS after FROM jobs) WHERE before IS DISTINCT FROM after""")
def repair_audit(s, d):
    cols = ("region", "industry", "salary_range")
    fixes = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), F.nullif(F.trim(c), F.lit("")).alias("after")) for c in cols])
    return table(s, d, "jobs").select("row_id", F.inline(fixes)).where("NOT (before <=> after)")


@query("""WITH x AS (SELECT row_id, source_record_id, CASE WHEN record_id IS NULL THEN 'quarantine' WHEN coalesce(published_at_confidence, 0) < 0.5 THEN 'review' ELSE 'staged' END AS destination FROM jobs)
 SELECT row_id, destination FROM x WHERE source_record_id IS NULL UNION ALL SELECT min(row_id), min_by(destination, row_id) FROM x WHERE source_record_id IS NOT NULL GROUP BY source_record_id""")
def staging_route(s, d):
    """The first row of each source record, by destination; rows without an identifier are each their own."""
    route = F.when(F.col("record_id").isNull(), "quarantine").when(F.coalesce("published_at_confidence", F.lit(0.0)) < 0.5, "review").otherwise("staged")
    x = table(s, d, "jobs").select("row_id", "source_record_id", route.alias("destination"))
    once = x.where("source_record_id IS NOT NULL").groupBy("source_record_id").agg(F.min("row_id").alias("row_id"), F.min_by("destination", "row_id").alias("destination"))
    return x.where("source_record_id IS NULL").select("row_id", "destination").unionByName(once.select("row_id", "destination"))


@query("""WITH a AS (SELECT DISTINCT region FROM jobs WHERE batch_no % 2 = 0 AND region IS NOT NULL), b AS (SELECT DISTINCT region FROM jobs WHERE batch_no % 2 = 1 AND region IS NOT NULL)
 SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)""")
def setops_regions(s, d):
    r = table(s, d, "jobs").where("region IS NOT NULL")
    a, b = r.where("batch_no % 2 = 0").select("region"), r.where("batch_no % 2 = 1").select("region")
    n = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))


@query("""WITH b AS (SELECT p_brand, p_partkey // 1000 AS piece, sha256(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS h FROM part GROUP BY ALL) SELECT p_brand, sha256(string_agg(h, ',' ORDER BY piece)) AS signature FROM b GROUP BY p_brand""")
def canonical_signature(s, d):
    """A digest of a group whatever the order of its rows: of the digests of its pieces, each of a thousand keys at most."""
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]].cast("string")), ","), 256)
    b = table(s, d, "part").select("p_brand", "p_partkey", F.floor(F.col("p_partkey") / 1000).alias("piece")).groupBy("p_brand", "piece").agg(joined(["p_partkey"]).alias("h"))
    return b.groupBy("p_brand").agg(joined(["piece", "h"]).alias("signature"))


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 5000), n AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey) SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.k = n.k""")
def upsert(s, d):
    o = table(s, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("old"))
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("new"))
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated")
    return o.join(n, "k", "full").select("k", F.coalesce("new", "old").alias("v"), outcome.alias("outcome"))


@query("SELECT row_id, tenant_id, JobAdId AS ad_id, trim(JobAdName, ' ') AS title, array_to_string(LocNames, ', ') AS cities, len(LocNames)::INT AS n_cities FROM beisen_list WHERE len(LocNames) > 0")
def ats_list_cities(s, d):
    b = table(s, d, "beisen_list").where(F.size("LocNames") > 0)
    return b.select("row_id", "tenant_id", F.col("JobAdId").alias("ad_id"), F.trim("JobAdName").alias("title"), F.array_join("LocNames", ", ").alias("cities"), F.size("LocNames").alias("n_cities"))


@query("""WITH p AS (SELECT page_id, unnest(data.job_post_list) AS x FROM feishu_list) SELECT page_id, x.id AS id, x.title AS title, array_to_string(list_transform(x.city_list, lambda c: c.name), ', ') AS cities, x.recruit_type.name AS recruit_type FROM p""")
def ats_page_posts(s, d):
    p = table(s, d, "feishu_list").select("page_id", F.explode("data.job_post_list").alias("x"))
    return p.select("page_id", "x.id", "x.title", F.array_join("x.city_list.name", ", ").alias("cities"), F.col("x.recruit_type.name").alias("recruit_type"))


@query("SELECT count(*) AS lines, count(*) FILTER (CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' ELSE false END) AS readable, count(DISTINCT file_name) AS files FROM boss_jobs")
def jsonl_scan(s, d):
    p = parse_lines(table(s, d, "boss_jobs"), "raw_line", ["file_name"])
    return p.agg(F.count("*").alias("lines"), F.count_if("readable").alias("readable"), F.count_distinct("file_name").alias("files"))


TIERS = [("1", "北京|上海|广州|深圳"), ("2", "杭州|成都|武汉|南京|西安|重庆|苏州|天津")]


@query("SELECT CASE " + " ".join(f"WHEN regexp_matches(region, '{p}') THEN '{t}'" for t, p in TIERS) + " WHEN region IS NULL THEN 'unknown' ELSE 'other' END AS tier, count(*) AS n, round(count(*) / (SELECT count(*) FROM jobs), 4) AS share FROM jobs GROUP BY tier")
def city_tier_share(s, d):
    tier = reduce(lambda c, tp: c.when(F.col("region").rlike(tp[1]), tp[0]), TIERS[1:], F.when(F.col("region").rlike(TIERS[0][1]), TIERS[0][0]))
    g = table(s, d, "jobs").groupBy(F.when(F.col("region").isNull(), "unknown").otherwise(F.coalesce(tier, F.lit("other"))).alias("tier")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))  # a handful of rows


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))::INT AS cjk, length(text)::INT AS chars FROM documents WHERE text IS NOT NULL")
def cjk_count(s, d):
    return docs(s, d).where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]")).alias("cjk"), F.length("text").alias("chars"))


@query("SELECT row_id, try_cast(collected_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS at_utc, year(try_cast(collected_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC')::INT AS year FROM jobs WHERE try_cast(collected_at AS TIMESTAMPTZ) IS NOT NULL")
def iso_to_utc(s, d):
    seconds = F.unix_seconds(F.try_to_timestamp("collected_at"))
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"), F.pmod(seconds, F.lit(60)).cast("decimal(18,6)"))
    return table(s, d, "jobs").select("row_id", at.alias("at_utc")).where("at_utc IS NOT NULL").withColumn("year", F.year("at_utc"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#./-]+')))[1] AS first_token, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#./-]+')))::INT AS tokens FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(lower(text), '[a-z0-9+#./-]+')) > 0")
def lexical_tokens(s, d):
    t = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9+#./-]+"), F.lit(0)))
    return docs(s, d).where("text IS NOT NULL").select("doc_id", t.alias("t")).where("size(t) > 0").select("doc_id", F.array_min("t").alias("first_token"), F.size("t").alias("tokens"))


_STOPS = ", ".join(f"'{t}'" for t in retrieval.STOP_TOKENS)


@query(f"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+#./-]+') AS words, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS runs FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, list_concat(list_transform(words, lambda w: lower(w)), flatten(list_transform(runs, lambda r: flatten(list_transform(range(2, least(6, length(r)) + 1), lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n))))))) AS t FROM r),
 k AS (SELECT doc_id, list_distinct(list_filter(t, lambda x: x NOT IN ({_STOPS}))) AS t FROM p) SELECT doc_id, list_transform(list_sort(list_transform(t, lambda x: {{'n': -length(x), 't': x}})), lambda x: x.t) AS tokens FROM k""")
def lexical_tokens_cjk(s, d):
    return docs(s, d).where("text IS NOT NULL").select("doc_id", retrieval.lexical_tokens(F.col("text")).alias("tokens"))


@query("""WITH c AS (SELECT f.job_family_id AS family, count(j.row_id) AS have FROM job_family f LEFT JOIN jobs j ON j.job_family_id = f.job_family_id GROUP BY f.job_family_id), t AS (SELECT family, have, greatest(0, 150 - have) AS deficit FROM c)
 SELECT family, have, deficit, least(deficit, greatest(0, 500 - coalesce(sum(deficit) OVER (ORDER BY have, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS planned FROM t""")
def deficit_schedule(s, d):
    have = table(s, d, "jobs").groupBy(F.col("job_family_id").alias("family")).agg(F.count("*").alias("have"))
    c = table(s, d, "job_family").select(F.col("job_family_id").alias("family")).join(have, "family", "left").fillna({"have": 0})
    t = c.withColumn("deficit", F.greatest(F.lit(0).cast("bigint"), 150 - F.col("have")))
    w = Window.partitionBy(F.lit(1)).orderBy("have", "family").rowsBetween(Window.unboundedPreceding, -1)  # a fixed list of 20
    zero = F.lit(0).cast("bigint")
    return t.withColumn("planned", F.least("deficit", F.greatest(zero, 500 - F.coalesce(F.sum("deficit").over(w), zero))))


@query("SELECT doc_kind, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY n_chars DESC NULLS LAST, doc_id) BETWEEN 3 AND 7")
def offset_paging(s, d):
    return retrieval.rank_within(docs(s, d), ["doc_kind"], F.desc_nulls_last("n_chars"), F.asc("doc_id")).where("rank BETWEEN 3 AND 7").select("doc_kind", "lang", "doc_id")


@query()
def resume_parse(s, d):
    """Résumés as records: sections, work, projects, skills with their evidence, months of experience."""
    r = docs(s, d).where("doc_kind = 'resume' AND text IS NOT NULL")
    return resume.parse(r, "doc_id", "text", (2026, 1))


@query("SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(\\d{1,2})\\s*(?:年|years?|Jahre|años|ans)', 1), lambda x: x::INT)) AS years, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*(?:%|percent|个百分点|倍|毫秒)'))::INT AS results FROM documents WHERE doc_kind = 'resume' AND text IS NOT NULL")
def resume_figures(s, d):
    """The longest time and the number of quantities a résumé states."""
    r = docs(s, d).where("doc_kind = 'resume' AND text IS NOT NULL")
    years = F.transform(F.regexp_extract_all("text", F.lit(r"(\d{1,2})\s*(?:年|years?|Jahre|años|ans)"), F.lit(1)), lambda x: x.cast("int"))
    results = F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?\s*(?:%|percent|个百分点|倍|毫秒)"), F.lit(0))
    return r.select("doc_id", F.array_max(years).alias("years"), F.size(results).alias("results"))


@query("SELECT user_id, max(ts) AS ts, count(*) AS seen FROM events GROUP BY user_id")
def stream_latest(s, d):
    return latest_by_stream(s, d)


QUERIES, ORACLE = Q, O
