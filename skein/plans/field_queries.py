"""Queries over normal forms of fields, times, skills, excerpts, snapshots, versions and checks of what was delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import fields, lexicon
from skein.functions.text import _NARROW, _WIDE, strip
from skein.operators import retrieval
from skein.plans import record_queries
from skein.plans.record_queries import TOKENS
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


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def jobs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs")


def _plain(c: str) -> str:
    return f"nullif(trim(regexp_replace(translate(translate({c}, {quoted(_WIDE)}, {quoted(_NARROW)}), '～~—–', '----'), '\\s+', ' ', 'g')), '')"


_EDU = " ".join(f"WHEN contains(e, '{x}') THEN '{x}' || CASE WHEN contains(e, '以上') THEN '及以上' ELSE '' END" for x in fields.LEVELS)
_CODE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fields.EDUCATION_CODES.items())
_YEARS = "^(\\d+)-?(\\d+)?年(?:工作)?(?:经验)?$"


@query(f"""WITH p AS (SELECT row_id, {_plain("education_requirement")} AS e, {_plain("experience_requirement")} AS x, {_plain("salary_range")} AS s, {_plain("region")} AS r FROM jobs),
 n AS (SELECT row_id, CASE {_EDU} WHEN e IN ('不限', '无要求', '学历不限') THEN '不限' ELSE e END AS education, CASE WHEN x IN ('不限', '无要求', '经验不限') THEN '不限' WHEN regexp_matches(x, '应届|无经验') THEN '无经验' WHEN regexp_matches(regexp_replace(x, '\\s+', '', 'g'), '{_YEARS}')
  THEN CASE WHEN regexp_extract(regexp_replace(x, '\\s+', '', 'g'), '{_YEARS}', 2) <> '' THEN regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '{_YEARS}', '\\1-\\2年') ELSE regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '{_YEARS}', '\\1年') END ELSE x END AS experience,
  replace(regexp_replace(s, '[¥￥\\s]+', '', 'g'), 'k', 'K') AS pay, regexp_replace(r, '\\s*([·,/])\\s*', '\\1', 'g') AS region FROM p)
 SELECT *, CASE regexp_replace(education, '及以上$', '') {_CODE} END AS education_code FROM n""")
def requirement_forms(s, d):
    edu = F.col("education_requirement")
    return jobs(s, d).select(
        "row_id", fields.education(edu).alias("education"), fields.experience(F.col("experience_requirement")).alias("experience"), fields.pay_text(F.col("salary_range")).alias("pay"),
        fields.region(F.col("region")).alias("region"), fields.education_code(edu).alias("education_code"),
    )


_FOREIGN = {"title": "job_title_raw", "description": "job_description_raw", "industry": "industry", "salary": "salary_range", "education": "education_requirement", "experience": "experience_requirement"}


def _why(field: str, c: str) -> str:
    more = [("salary", fields._SALARY, "salary_pattern"), ("education", "本科|硕士|博士|大专|学历", "education_pattern"), ("experience", "\\d+\\s*年(?:以上)?(?:工作)?经验|经验不限", "experience_pattern")]
    cases = " ".join(f"WHEN regexp_matches({_plain(c)}, '{p}') THEN '{w}'" for f, p, w in more if f != field)
    return f"CASE WHEN regexp_matches({c}, '[\\r\\n]') THEN 'multiline_text' WHEN length({_plain(c)}) > 80 THEN 'too_long' WHEN regexp_matches({_plain(c)}, '{fields._WANTED}') THEN 'requirement_text' {cases} END"


@query("SELECT row_id, field, reason FROM (" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS field, {_why(f, c)} AS reason FROM jobs" for f, c in _FOREIGN.items()) + ") WHERE reason IS NOT NULL")
def foreign_fields(s, d):
    found = F.array(*[F.struct(F.lit(f).alias("field"), fields.foreign(F.col(c), f).alias("reason")) for f, c in _FOREIGN.items()])
    return jobs(s, d).select("row_id", F.inline(F.filter(found, lambda x: x["reason"].isNotNull())))


@query("""SELECT row_id, coalesce(family_name, trim(regexp_replace(regexp_replace(regexp_replace(job_title_raw, '[（(].*?[）)]', '', 'g'), '^[^-—]{1,10}[-—]', ''), '^(?:初级|中级|高级资深|高级|资深|专家)', ''))) AS title, family_name IS NOT NULL AS known
 FROM jobs LEFT JOIN job_family USING (job_family_id) WHERE job_title_raw IS NOT NULL""")
def title_forms(s, d):
    j = jobs(s, d).where("job_title_raw IS NOT NULL").join(table(s, d, "job_family").select("job_family_id", "family_name"), "job_family_id", "left")
    return j.select("row_id", F.coalesce("family_name", fields.title(F.col("job_title_raw"))).alias("title"), F.col("family_name").isNotNull().alias("known"))


_LEX = "lex(name, category, alias) AS (VALUES " + ", ".join(f"('{n}', '{c}', '{a}')" for n, c, a in lexicon.ALIASES) + ")"
_SIDE = "substring(text, greatest(1, pos - 18), pos + length(alias) + 24 - greatest(1, pos - 18))"


@query(f"""WITH {_LEX}, h AS (SELECT doc_id, text, name, category, alias, instr(lower(text), alias) AS pos FROM documents, lex WHERE contains(lower(text), alias)),
 b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY pos, -length(alias)) = 1), e AS (SELECT *, trim({_SIDE}, ' ' || chr(9) || chr(10) || chr(13)) AS evidence FROM b)
 SELECT doc_id, name, category, alias, pos::INT AS pos, md5(evidence) AS evidence, CASE WHEN regexp_matches(lower(evidence), '{"|".join(lexicon.PREFERRED)}') THEN 'preferred' ELSE 'required' END AS requirement, CASE WHEN alias = lower(name) THEN 0.92 ELSE 0.86 END AS confidence FROM e""")
def skills_named(s, d):
    found = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.inline(lexicon.mentions(F.col("text"))))
    return found.withColumn("evidence", F.md5("evidence"))


@query(f"""WITH {_LEX}, known AS (SELECT lower(name) AS key, name, category FROM lex UNION SELECT alias, name, category FROM lex), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9+#./-]+')) AS word FROM documents)
 SELECT word, coalesce(name, word) AS name, coalesce(category, 'general') AS category FROM w LEFT JOIN known ON lower(word) = key""")
def skill_canonical(s, d):
    w = table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+#./-]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", lexicon.canonical_skill(F.col("word")).alias("k")).select("word", "k.name", "k.category")


_PART = "[^。；;\\n]{8,180}"
_BULLET = "^\\s*(?:\\d+[、.)）]|[-•·])\\s*"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || '　'"


@query(f"""WITH p AS (SELECT row_id, unnest(regexp_extract_all(job_description_raw, '{_PART}')) AS raw, generate_subscripts(regexp_extract_all(job_description_raw, '{_PART}'), 1) AS spot FROM jobs),
 m AS (SELECT row_id, spot, trim(regexp_replace(raw, '{_BULLET}', ''), {_BLANKS}) AS name FROM p), k AS (SELECT *, translate(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '和及与', '') AS key FROM m WHERE regexp_matches(name, '{"|".join(lexicon.RESPONSIBLE)}')),
 u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY row_id, key ORDER BY spot) = 1) SELECT row_id, name, row_number() OVER (PARTITION BY row_id ORDER BY spot) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY spot) <= 12""")
def responsibilities(s, d):
    p = jobs(s, d).select("row_id", F.posexplode(F.regexp_extract_all("job_description_raw", F.lit(_PART), F.lit(0))).alias("at", "raw"))
    m = p.select("row_id", "at", F.trim(F.regexp_replace("raw", _BULLET, ""), F.lit(" \t\n\r　")).alias("name")).where(F.col("name").rlike("|".join(lexicon.RESPONSIBLE)))
    once = m.groupBy("row_id", fields.wording(F.col("name")).alias("key")).agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    return retrieval.rank_within(once, ["row_id"], F.asc("at")).where("rank <= 12").select("row_id", "name", "rank")


@query("SELECT row_id, substring(source_name, 1, 47) || '-' || substring(sha256(source_name || chr(0) || source_record_id), 1, 32) AS id FROM jobs WHERE source_name IS NOT NULL AND source_record_id IS NOT NULL")
def record_ids(s, d):
    return jobs(s, d).where("source_name IS NOT NULL AND source_record_id IS NOT NULL").select("row_id", fields.record_id(F.col("source_name"), F.col("source_record_id")).alias("id"))


_YEAR_LIST = "list_transform(regexp_extract_all(coalesce(experience_requirement, ''), '\\d+'), lambda y: y::INT)"
_T, _D = "coalesce(job_title_raw, '')", "coalesce(job_description_raw, '')"


@query(f"""WITH y AS (SELECT row_id, {_T} AS t, {_D} AS x, list_min({_YEAR_LIST}) AS lo FROM jobs),
 e AS (SELECT *, CASE WHEN lo IS NULL THEN NULL WHEN lo <= 2 THEN 'junior' WHEN lo <= 5 THEN 'mid' ELSE 'senior' END AS by_years,
  CASE WHEN regexp_matches(t, '专家|首席|技术负责人|技术总监') THEN CASE WHEN regexp_matches(x, '技术规划|团队管理|跨部门决策|标准制定|行业标准') THEN 'expert' ELSE 'senior' END WHEN regexp_matches(t, '高级|资深|架构师') THEN 'senior' WHEN regexp_matches(t, '初级|助理|应届|实习') THEN 'junior' END AS by_title,
  CASE WHEN regexp_matches(x, '架构设计|技术攻关|指导成员|带领团队') THEN 'senior' WHEN regexp_matches(x, '独立完成|独立交付') THEN 'mid' END AS by_text FROM y)
 SELECT row_id, coalesce(by_title, by_years, by_text, 'unspecified') AS level, CASE WHEN by_title IS NOT NULL THEN CASE WHEN by_years <> by_title THEN 0.85 ELSE 0.95 END WHEN by_years IS NOT NULL THEN 0.85 WHEN by_text IS NOT NULL THEN 0.75 ELSE 0.0 END AS confidence,
  coalesce(by_title <> by_years, false) AS conflict FROM e""")
def seniority_levels(s, d):
    t, x = F.coalesce("job_title_raw", F.lit("")), F.coalesce("job_description_raw", F.lit(""))
    lo = F.array_min(F.transform(F.regexp_extract_all(F.coalesce("experience_requirement", F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda y: y.try_cast("int")))
    by_years = F.when(lo <= 2, "junior").when(lo <= 5, "mid").when(lo > 5, "senior")
    lead = F.when(x.rlike("技术规划|团队管理|跨部门决策|标准制定|行业标准"), "expert").otherwise("senior")
    by_title = F.when(t.rlike("专家|首席|技术负责人|技术总监"), lead).when(t.rlike("高级|资深|架构师"), "senior").when(t.rlike("初级|助理|应届|实习"), "junior")
    by_text = F.when(x.rlike("架构设计|技术攻关|指导成员|带领团队"), "senior").when(x.rlike("独立完成|独立交付"), "mid")
    conflict = F.coalesce(by_title != by_years, F.lit(False))
    sure = F.when(by_title.isNotNull(), F.when(conflict, 0.85).otherwise(0.95)).when(by_years.isNotNull(), 0.85).when(by_text.isNotNull(), 0.75).otherwise(0.0)
    return jobs(s, d).select("row_id", F.coalesce(by_title, by_years, by_text, F.lit("unspecified")).alias("level"), sure.alias("confidence"), conflict.alias("conflict"))


_WORTH = " + ".join(f"CASE WHEN contains(substring(low, spot + 1, 200), '{t}') THEN {len(t)} ELSE 0 END" for t in TOKENS)


@query(f"""WITH x AS (SELECT doc_id, text, lower(text) AS low, length(text) - 200 AS room, list_filter([{", ".join(f"instr(lower(text), '{t}')" for t in TOKENS)}], lambda p: p > 0) AS spots FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, text, low, room, unnest(list_distinct(CASE WHEN len(spots) = 0 THEN [0] ELSE list_transform(spots, lambda p: greatest(0, least(p - 1 - 66, room))) END)) AS spot FROM x),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_WORTH} DESC, spot) AS r FROM s) SELECT doc_id, CASE WHEN room <= 0 THEN 1 ELSE spot + 1 END::INT AS start_at, md5(CASE WHEN room <= 0 THEN text ELSE substring(text, spot + 1, 200) END) AS excerpt FROM b WHERE r = 1""")
def best_excerpt(s, d):
    x = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text", fields.excerpt_at(F.col("text"), TOKENS, 200).alias("start_at"))
    return x.select("doc_id", "start_at", F.md5(F.when(F.length("text") <= 200, F.col("text")).otherwise(F.substring("text", F.col("start_at"), F.lit(200)))).alias("excerpt"))


@query("""WITH k AS (SELECT DISTINCT unnest(json_keys(raw_line)) AS key FROM lagou_jobs WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' ELSE false END)
 SELECT key, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(key, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9一-鿿]+'), lambda w: w <> ''), ' ') AS words FROM k""")
def key_words(s, d):
    p = parse_lines(table(s, d, "lagou_jobs"), "raw_line", ["row_id"]).where("readable")
    k = p.select(F.explode(F.expr("map_keys(CAST(obj AS MAP<STRING, VARIANT>))")).alias("key")).distinct()
    return k.select("key", F.array_join(fields.key_words(F.col("key")), " ").alias("words"))


_TITLE_KEYS = ["job_name", "title", "position", "name"]


@query(f"""WITH r AS (SELECT row_id, raw_line FROM lagou_jobs WHERE CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' ELSE false END)
 SELECT row_id, coalesce({", ".join(f"CASE WHEN json_type(raw_line, '$.{k}') = 'VARCHAR' THEN nullif(trim(json_extract_string(raw_line, '$.{k}')), '') END" for k in _TITLE_KEYS)}) AS title FROM r""")
def export_titles(s, d):
    """The first of several names of a field that has a text."""
    p = parse_lines(table(s, d, "lagou_jobs"), "raw_line", ["row_id"]).where("readable")
    one = lambda k: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(obj, '$.{k}', 'variant')) = 'STRING' THEN nullif(regexp_replace(try_variant_get(obj, '$.{k}', 'string'), '(?U)^\\\\s+|\\\\s+$', ''), '') END")
    return p.select("row_id", F.coalesce(*[one(k) for k in _TITLE_KEYS]).alias("title"))


_ISO = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}$"


@query(f"SELECT row_id, try_cast(replace(published_at, 'T', ' ') AS TIMESTAMP) - INTERVAL 8 HOUR AS at_utc FROM jobs WHERE regexp_matches(published_at, '{_ISO}')")
def home_time(s, d):
    """ISO times without zone, taken as China time."""
    return jobs(s, d).where(F.col("published_at").rlike(_ISO)).select("row_id", F.expr("try_cast(replace(published_at, 'T', ' ') AS timestamp_ntz) - INTERVAL '8' HOUR").alias("at_utc"))


@query("SELECT row_id, try_cast(replace(regexp_replace(collected_at, '(?:Z|[+-]\\d{2}:?\\d{2})$', ''), 'T', ' ') AS TIMESTAMP) AS wall FROM jobs WHERE collected_at IS NOT NULL")
def wall_time(s, d):
    return jobs(s, d).where("collected_at IS NOT NULL").select("row_id", F.regexp_replace("collected_at", r"(?:Z|[+-]\d{2}:?\d{2})$", "").alias("w")).select("row_id", F.expr("try_cast(replace(w, 'T', ' ') AS timestamp_ntz)").alias("wall"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate - INTERVAL 3 YEAR AS before, ((year(l_shipdate) * 12 + month(l_shipdate)) - (year(o_orderdate) * 12 + month(o_orderdate)) + 1)::INT AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def calendar_spans(s, d):
    """Calendar years before a time (29 February becomes 28) and whole months from one time to another, both counted."""
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    index = lambda c: F.year(c) * 12 + F.month(c)
    return x.select("l_orderkey", "l_linenumber", (F.col("o_orderdate") - F.expr("INTERVAL '3' YEAR")).alias("before"), (index("l_shipdate") - index("o_orderdate") + 1).alias("months"))


@query("SELECT event_id, greatest(0.0, least(1.0, coalesce(value / 100, 0.0))) AS score, greatest(0.0, least(1.0, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0))) AS k FROM events")
def clamped_scores(s, d):
    return table(s, d, "events").select("event_id", fields.clamp(F.col("value") / 100).alias("score"), fields.clamp(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT row_id, job_family_id, row_number() OVER (PARTITION BY job_family_id ORDER BY row_id DESC) AS rank FROM jobs QUALIFY row_number() OVER (PARTITION BY job_family_id ORDER BY row_id DESC) <= 500")
def recent_window(s, d):
    """The latest 500 rows of each family."""
    return retrieval.rank_within(jobs(s, d).select("row_id", "job_family_id"), ["job_family_id"], F.desc("row_id")).where("rank <= 500")


@query("SELECT f.job_family_id, coalesce(max(batch_no), 0) + 1 AS version, count(row_id) AS n FROM job_family f LEFT JOIN jobs j USING (job_family_id) GROUP BY f.job_family_id")
def next_version(s, d):
    f = table(s, d, "job_family").select("job_family_id").join(jobs(s, d).select("job_family_id", "batch_no", "row_id"), "job_family_id", "left")
    return f.groupBy("job_family_id").agg((F.coalesce(F.max("batch_no"), F.lit(0)) + 1).alias("version"), F.count("row_id").alias("n"))


@query("""SELECT o_custkey, p_brand, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)::INT AS rank, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS sources
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand""")
def skill_merge(s, d):
    """Records of one skill of one person as one: the best rank, the union of the sources."""
    x = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return x.groupBy("o_custkey", "p_brand").agg(F.max(rank).alias("rank"), F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("sources"))


@query("SELECT page_id, data.count AS declared, len(data.job_post_list)::INT AS held, data.count = len(data.job_post_list) AS agrees FROM feishu_list WHERE data IS NOT NULL AND data.job_post_list IS NOT NULL")
def page_reconcile(s, d):
    """What a page declares against what it holds."""
    p = table(s, d, "feishu_list").where("data IS NOT NULL AND data.job_post_list IS NOT NULL")
    return p.select("page_id", F.col("data.count").alias("declared"), F.size("data.job_post_list").alias("held")).withColumn("agrees", F.col("declared") == F.col("held"))


@query("""SELECT tenant_id, count(*) AS n, count(DISTINCT JobAdId) AS ads, count(*) FILTER (JobAdName IS NOT NULL) AS named, bool_and(JobAdId IS NOT NULL) AS all_identified, round(count(Salary) / count(*), 4) AS pay_share,
 count(*) FILTER (len(LocNames) > 0) AS placed FROM beisen_list GROUP BY tenant_id""")
def tenant_preflight(s, d):
    b = table(s, d, "beisen_list")
    return b.groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.count_distinct("JobAdId").alias("ads"), F.count("JobAdName").alias("named"), F.every(F.col("JobAdId").isNotNull()).alias("all_identified"),
        F.round(F.count("Salary") / F.count("*"), 4).alias("pay_share"), F.count_if(F.size("LocNames") > 0).alias("placed"),
    )


_SNAP = "SELECT record_id, company_name, region, salary_range FROM jobs WHERE record_id IS NOT NULL AND {} QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY row_id DESC) = 1"


@query(f"""WITH m AS (SELECT max(batch_no) // 2 AS half FROM jobs), a AS ({_SNAP.format("batch_no <= (SELECT half FROM m)")}), b AS ({_SNAP.format("batch_no > (SELECT half FROM m)")})
 SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN a.record_id IS NULL THEN 'added' WHEN b.record_id IS NULL THEN 'removed' WHEN (a.company_name, a.region, a.salary_range) IS DISTINCT FROM (b.company_name, b.region, b.salary_range) THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.record_id = b.record_id""")
def snapshot_diff(s, d):
    j = jobs(s, d).where("record_id IS NOT NULL").select("record_id", "row_id", "batch_no", F.struct("company_name", "region", "salary_range").alias("item"))
    j = s.sql("SELECT *, batch_no > (SELECT max(batch_no) div 2 FROM {j}) AS later FROM {j}", j=jobs(s, d).select("batch_no", "row_id")).select("row_id", "later").join(j, "row_id")
    # One pass: the last item on either side of the cut.
    side = lambda on: F.max_by(F.when(F.col("later") == F.lit(on), F.col("item")), F.when(F.col("later") == F.lit(on), F.col("row_id")))
    g = j.groupBy("record_id").agg(side(False).alias("a"), side(True).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return g.select("record_id", kind.alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, b.n_name AS buyer, s.n_name AS seller, coalesce(b.n_regionkey = s.n_regionkey, false) AS near FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
 LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey WHERE l_quantity > 45""")
def both_sides(s, d):
    """One table joined twice, under two names."""
    n = table(s, d, "nation")
    b, e = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer"), F.col("n_regionkey").alias("br")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"), F.col("n_regionkey").alias("sr"))
    li = table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    x = li.join(o, "l_orderkey").join(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "left").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    return x.join(b, "c_nationkey", "left").join(e, "s_nationkey", "left").select("l_orderkey", "l_linenumber", "buyer", "seller", F.coalesce(F.col("br") == F.col("sr"), F.lit(False)).alias("near"))


@query("SELECT EXISTS (SELECT 1 FROM jobs JOIN job_source USING (source_name) WHERE quality_score >= 0.9) AS some_good, EXISTS (SELECT 1 FROM jobs JOIN job_source USING (source_name) WHERE quality_score > 1) AS some_wrong")
def scalar_exists(s, d):
    j = jobs(s, d).select("source_name", "quality_score").join(table(s, d, "job_source").select("source_name").distinct(), "source_name", "left_semi")
    some = lambda c: F.coalesce(F.bool_or(F.expr(c)), F.lit(False))
    return j.agg(some("quality_score >= 0.9").alias("some_good"), some("quality_score > 1").alias("some_wrong"))


@query("""WITH k AS (SELECT DISTINCT job_family_id, region, batch_no FROM jobs), m AS (SELECT max(batch_no) AS last FROM jobs) SELECT DISTINCT job_family_id, region FROM k WHERE batch_no < (SELECT last FROM m) AND job_family_id IS NOT NULL AND region IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM k n WHERE n.batch_no = (SELECT last FROM m) AND n.job_family_id = k.job_family_id AND n.region = k.region)""")
def not_regenerated(s, d):
    """Slices of earlier batches that the last batch does not have."""
    k = jobs(s, d).where("job_family_id IS NOT NULL AND region IS NOT NULL").groupBy("job_family_id", "region").agg(F.max("batch_no").alias("newest"))
    last = jobs(s, d).agg(F.max("batch_no").alias("last"))
    return s.sql("SELECT job_family_id, region FROM {k} WHERE newest < (SELECT last FROM {m})", k=k, m=last)


@query(f"""WITH {_LEX}, s AS (SELECT DISTINCT row_id FROM jobs, lex WHERE contains(lower(job_description_raw), alias)), r AS (SELECT row_id FROM jobs WHERE regexp_matches(job_description_raw, '{"|".join(lexicon.RESPONSIBLE)}')), u AS (FROM s UNION FROM r)
 SELECT row_id, row_id IN (FROM u) AS has_evidence FROM jobs""")
def capability_keys(s, d):
    """Rows that name a skill or a responsibility: the union of two sets of keys, as a flag."""
    j = jobs(s, d).select("row_id", "job_description_raw")
    low = F.lower("job_description_raw")
    any_skill = F.exists(F.array(*[F.lit(a) for _, _, a in lexicon.ALIASES]), lambda a: F.contains(low, a))
    return j.select("row_id", F.coalesce(any_skill | F.col("job_description_raw").rlike("|".join(lexicon.RESPONSIBLE)), F.lit(False)).alias("has_evidence"))


_HASH = "md5(coalesce(job_title_raw, '') || chr(1) || coalesce(company_name, '') || chr(1) || coalesce(salary_range, '') || chr(1) || coalesce(job_description_raw, ''))"


@query(f"""WITH o AS (SELECT row_id, record_id, last_seen_at AS seen_at, {_HASH} AS h FROM jobs WHERE record_id IS NOT NULL AND last_seen_at IS NOT NULL),
 n AS (SELECT *, max(seen_at) OVER w AS newest, row_number() OVER (PARTITION BY record_id ORDER BY row_id) AS seq, count(*) OVER (PARTITION BY record_id, h ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM o WINDOW w AS (PARTITION BY record_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT row_id, record_id, CASE WHEN seq = 1 THEN 'new' WHEN same > 0 THEN 'unchanged' WHEN seen_at < newest THEN 'stale_revision' WHEN seen_at = newest THEN 'equal_time_conflict' ELSE 'revised' END AS outcome FROM n""")
def revision_outcomes(s, d):
    """What each observation of a record is to those before it: new, unchanged, a late older one, one of the same time with another content, or a revision."""
    parts = [x for c in ("job_title_raw", "company_name", "salary_range", "job_description_raw") for x in (F.coalesce(c, F.lit("")), F.lit("\x01"))][:-1]
    o = jobs(s, d).where("record_id IS NOT NULL AND last_seen_at IS NOT NULL").select("row_id", "record_id", F.col("last_seen_at").alias("at"), F.md5(F.concat(*parts)).alias("h"))
    before = Window.partitionBy("record_id").orderBy("row_id")
    prior = before.rowsBetween(Window.unboundedPreceding, -1)
    same = F.lag("row_id").over(Window.partitionBy("record_id", "h").orderBy("row_id")).isNotNull()
    n = o.select("row_id", "record_id", "at", same.alias("same"), F.max("at").over(prior).alias("newest"))
    outcome = F.when(F.col("newest").isNull(), "new").when(F.col("same"), "unchanged").when(F.col("at") < F.col("newest"), "stale_revision").when(F.col("at") == F.col("newest"), "equal_time_conflict").otherwise("revised")
    return n.select("row_id", "record_id", outcome.alias("outcome"))


@query(f"""WITH o AS (SELECT record_id, last_seen_at AS seen_at, {_HASH} AS h, row_id FROM jobs WHERE record_id IS NOT NULL AND last_seen_at IS NOT NULL), b AS (SELECT record_id, max(seen_at) AS seen_at, min(row_id) AS first_row, count(DISTINCT h) AS contents FROM o GROUP BY record_id)
 SELECT b.record_id, b.seen_at, min(h) AS h, any_value(first_row) AS first_row, any_value(contents) AS contents FROM b JOIN o USING (record_id, seen_at) GROUP BY b.record_id, b.seen_at""")
def current_revision(s, d):
    """The content in force per record: the newest, of equal times the least hash, in whatever order observations arrive."""
    parts = [x for c in ("job_title_raw", "company_name", "salary_range", "job_description_raw") for x in (F.coalesce(c, F.lit("")), F.lit("\x01"))][:-1]
    o = jobs(s, d).where("record_id IS NOT NULL AND last_seen_at IS NOT NULL").select("row_id", "record_id", F.col("last_seen_at").alias("seen_at"), F.md5(F.concat(*parts)).alias("h"))
    # Partial aggregates per (record, time) keep a record of very many observations from one task.
    each = o.groupBy("record_id", "seen_at").agg(F.min("h").alias("h"), F.min("row_id").alias("first_row"))
    best = each.groupBy("record_id").agg(F.max("seen_at").alias("seen_at"), F.max_by("h", "seen_at").alias("h"), F.min("first_row").alias("first_row"))
    return best.join(o.groupBy("record_id").agg(F.count_distinct("h").alias("contents")), "record_id").select("record_id", "seen_at", "h", "first_row", "contents")


@query("""WITH f AS (SELECT account_id, file_no, min(row_id) AS first_row, sha256(string_agg(coalesce(sha256(raw_line), ''), '' ORDER BY coalesce(sha256(raw_line), ''))) AS h, count(*) AS n FROM boss_jobs GROUP BY account_id, file_no)
 SELECT account_id, file_no, n, first_row, first_row = min(first_row) OVER (PARTITION BY h) AS accepted FROM f""")
def file_idempotency(s, d):
    """Files by content: of equal ones, whatever the order of their lines, only the first is accepted."""
    lines = table(s, d, "boss_jobs").select("account_id", "file_no", "row_id", F.coalesce(F.sha2("raw_line", 256), F.lit("")).alias("x"))
    f = lines.groupBy("account_id", "file_no").agg(F.min("row_id").alias("first_row"), F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256).alias("h"), F.count("*").alias("n"))  # a file's lines are bounded
    return f.select("account_id", "file_no", "n", "first_row", (F.col("first_row") == F.min("first_row").over(Window.partitionBy("h"))).alias("accepted"))


_SEV = [("quality_score < 0.5", "low_quality", 3), ("quality_score < 0.7", "low_quality", 2), ("region IS NULL", "no_region", 1), ("industry IS NULL", "no_industry", 1), ("salary_range IS NULL AND region IS NULL", "no_region", 2)]


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS code, {r} AS severity FROM jobs WHERE {p}" for p, c, r in _SEV) + ") SELECT row_id, code, max(severity)::INT AS severity, count(*) AS findings FROM x GROUP BY row_id, code")
def severity_merge(s, d):
    """Findings of one code as one, of the highest severity."""
    all_of = F.array(*[F.when(F.expr(p), F.struct(F.lit(c).alias("code"), F.lit(r).alias("severity"))) for p, c, r in _SEV])
    x = jobs(s, d).select("row_id", F.inline(F.array_compact(all_of)))
    return x.groupBy("row_id", "code").agg(F.max("severity").alias("severity"), F.count("*").alias("findings"))


_KEYS = {"jobs": "record_id", "job_source": "source_id", "city": "city_id", "beisen_list": "JobAdId", "documents": "doc_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM {t} WHERE {k} IS NULL) AS missing" for t, k in _KEYS.items()))
def key_uniqueness(s, d):
    """Per table how many keys occur again, and how many rows have none."""
    out = None
    for t, k in _KEYS.items():
        g = table(s, d, t).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n"))
        one = g.agg(F.count_if((F.col("n") > 1) & F.col("k").isNotNull()).alias("repeated"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("missing")).select(F.lit(t).alias("table_name"), "repeated", "missing")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH x AS (SELECT row_id, to_json(LocNames) AS j FROM beisen_list WHERE LocNames IS NOT NULL) SELECT row_id, generate_subscripts(json_extract(j, '$[*]'), 1) AS item_no, unnest(json_extract(j, '$[*]'))::VARCHAR AS raw FROM x")
def json_items(s, d):
    """The items of a JSON array, each as its own JSON text, with their numbers."""
    x = table(s, d, "beisen_list").where("LocNames IS NOT NULL").select("row_id", F.to_json("LocNames").alias("j"))
    return s.sql("SELECT row_id, cast(e.pos + 1 AS bigint) AS item_no, to_json(e.value) AS raw FROM {x} x, LATERAL variant_explode(try_parse_json(x.j)) e", x=x)


_TERMS = ["kafka", "docker", "sql", "python", "go", "git", "监控", "发布"]


def _named(t: str) -> str:
    word = t.isascii()
    lead, trail = ("(?:^|[^a-z0-9])", "(?:$|[^a-z0-9])") if word else ("", "")
    return f"regexp_matches(regexp_replace(low, '(?:{fields.NEGATIONS})[\\s、/和与及的]{{0,12}}{t}', '\x01', 'g'), '{lead}{t}{trail}')"


@query(f"WITH x AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_named(t)} THEN {quoted(t)} END' for t in _TERMS)}], lambda z: z IS NOT NULL), ',') AS terms FROM x) FROM y WHERE terms <> ''")
def named_terms(s, d):
    """The terms a text names as words of their own and does not deny."""
    x = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    found = F.array_join(F.array_compact(F.array(*[F.when(fields.named(F.col("low"), t), t) for t in _TERMS])), ",")
    return x.select("doc_id", found.alias("terms")).where("terms <> ''")


@query(f"""WITH e AS ({record_queries.O["evidence_merge_topk"]}), t AS (SELECT e.cite, e.score, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180) AS excerpt, substring(e.cite, 2)::INT AS rank FROM e JOIN documents USING (doc_id))
 SELECT cite, rank, '- [' || cite || '] ' || excerpt AS line, true AS valid FROM t WHERE rank <= 3""")
def extractive_answer(s, d):
    """The lines of an answer made of the three best pieces of evidence, with a check of what it cites."""
    e = record_queries.Q["evidence_merge_topk"](s, d)
    t = e.withColumn("rank", F.substring("cite", 2, 9).cast("int")).where("rank <= 3").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit("- ["), "cite", F.lit("] "), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 180))
    return t.select("cite", "rank", line.alias("line")).withColumn("valid", F.array_contains(fields.cited(F.col("line")), F.col("cite")))


_CHUNK = "sha256('job_posting:' || row_id || ':' || sha256(coalesce(job_title_raw, '') || chr(10) || job_description_raw))"


@query(f"""WITH c AS (SELECT row_id, record_id, batch_no, {_CHUNK} AS chunk_id FROM jobs WHERE job_description_raw IS NOT NULL), old AS (SELECT chunk_id FROM c WHERE batch_no % 2 = 0) SELECT row_id, chunk_id, CASE WHEN chunk_id IN (FROM old) THEN 'updated' ELSE 'created' END AS outcome FROM c""")
def chunk_refresh(s, d):
    """Pieces of knowledge named by their content; those there already are updated, others created."""
    text = F.concat(F.coalesce("job_title_raw", F.lit("")), F.lit("\n"), "job_description_raw")
    c = jobs(s, d).where("job_description_raw IS NOT NULL").select("row_id", "batch_no", F.sha2(F.concat(F.lit("job_posting:"), F.col("row_id").cast("string"), F.lit(":"), F.sha2(text, 256)), 256).alias("chunk_id"))
    old = c.where("batch_no % 2 = 0").select("chunk_id").distinct().withColumn("there", F.lit(True))
    return c.join(old, "chunk_id", "left").select("row_id", "chunk_id", F.when(F.col("there"), "updated").otherwise("created").alias("outcome"))


@query("""WITH r AS (SELECT max(l_shipdate) AS ref FROM lineitem), m AS (SELECT o_custkey, p_brand, max(year(l_shipdate) * 12 + month(l_shipdate)) AS used FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand)
 SELECT o_custkey, count(*) AS recent FROM m, r WHERE (year(ref) * 12 + month(ref)) - used BETWEEN 0 AND 24 GROUP BY o_custkey""")
def recent_skills(s, d):
    """What each candidate used within 24 months before the reference date."""
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    index = lambda c: F.year(c) * 12 + F.month(c)
    m = x.groupBy("o_custkey", "p_brand").agg(F.max(index("l_shipdate")).alias("used"))
    ref = table(s, d, "lineitem").agg(index(F.max("l_shipdate")).alias("ref"))
    recent = s.sql("SELECT o_custkey FROM {m} WHERE (SELECT ref FROM {r}) - used BETWEEN 0 AND 24", m=m, r=ref)
    return recent.groupBy("o_custkey").agg(F.count("*").alias("recent"))






@query("""WITH f AS (SELECT count(*) FILTER (quality_score >= 0.7) AS usable, count(DISTINCT job_family_id) AS families, count(DISTINCT batch_no) AS batches, max(batch_no) AS last FROM jobs), c AS (SELECT round(max(n) / sum(n), 4) AS share_max FROM (SELECT count(*) AS n FROM jobs GROUP BY source_name)),
 m AS (SELECT unnest(['usable', 'share_max', 'families', 'batches_agree', 'nothing']) AS metric, unnest([usable::DOUBLE, share_max::DOUBLE, families::DOUBLE, CASE WHEN batches = last + 1 THEN 1.0 ELSE 0.0 END, NULL]) AS value, unnest([100.0, NULL, 5.0, 1.0, 1.0]) AS least, unnest([NULL, 0.35, 500.0, 1.0, NULL]) AS most FROM f, c)
 SELECT metric, value, CASE WHEN value IS NULL THEN 'not_measured' WHEN value < least OR value > most THEN 'failed' ELSE 'passed' END AS status, round(greatest(coalesce(least - value, 0), coalesce(value - most, 0), 0), 4) AS gap FROM m""")
def target_status(s, d):
    """Measures against targets: a least, a most, a range, an exact number; the gap to the target, and what was not measured."""
    j = jobs(s, d)
    f = j.agg(F.count_if(F.col("quality_score") >= 0.7).alias("usable"), F.count_distinct("job_family_id").alias("families"), F.count_distinct("batch_no").alias("batches"), F.max("batch_no").alias("last"))
    c = j.groupBy("source_name").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 4).alias("share_max"))
    n = lambda x: F.lit(x).cast("double")
    row = lambda name, v, lo, hi: F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"), n(lo).alias("least"), n(hi).alias("most"))
    m = s.sql("SELECT *, (SELECT share_max FROM {c}) AS share_max FROM {f}", f=f, c=c).select(F.inline(F.array(
        row("usable", F.col("usable"), 100, None), row("share_max", F.col("share_max"), None, 0.35), row("families", F.col("families"), 5, 500),
        row("batches_agree", F.when(F.col("batches") == F.col("last") + 1, 1).otherwise(0), 1, 1), row("nothing", F.lit(None), 1, None),
    )))
    gap = F.round(F.greatest(F.coalesce(F.col("least") - F.col("value"), n(0)), F.coalesce(F.col("value") - F.col("most"), n(0)), n(0)), 4)
    status = F.when(F.col("value").isNull(), "not_measured").when((F.col("value") < F.col("least")) | (F.col("value") > F.col("most")), "failed").otherwise("passed")
    return m.select("metric", "value", status.alias("status"), gap.alias("gap"))


@query(f"""WITH t AS ({record_queries.O["cosine_topk"]}), l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), h AS (SELECT t.query_id, count(*) FILTER (a.label = b.label) AS hits FROM t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.vec_id GROUP BY t.query_id)
 SELECT query_id, hits, round(hits / least(5, n - 1), 6) AS recall FROM h JOIN embeddings e ON e.vec_id = query_id JOIN l ON l.label = e.label WHERE n > 1""")
def recall_at_five(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    top = record_queries.Q["cosine_topk"](s, d)
    own, other = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("mine")), e
    h = top.join(own, "query_id").join(other, "vec_id").groupBy("query_id", "mine").agg(F.count_if(F.col("mine") == F.col("label")).alias("hits"))
    n = e.groupBy(F.col("label").alias("mine")).agg(F.count("*").alias("n")).where("n > 1")
    return h.join(n, "mine").select("query_id", "hits", F.round(F.col("hits") / F.least(F.lit(5), F.col("n") - 1), 6).alias("recall"))


@query("""WITH p AS (SELECT o_orderkey, c_mktsegment AS family, o_orderpriority AS level, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS period FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT DISTINCT family, level, period, p_brand AS skill, o_orderkey FROM p JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
 SELECT family, level, period, skill, o_orderkey, row_number() OVER (PARTITION BY family, level, period, skill ORDER BY o_orderkey) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY family, level, period, skill ORDER BY o_orderkey) <= 3""")
def profile_evidence(s, d):
    """Three records that show each skill of each profile (family, level, quarter)."""
    from skein.plans.profile_queries import links, postings

    e = postings(s, d).select("o_orderkey", "family", "level", "period").join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    return retrieval.rank_within(e, ["family", "level", "period", "skill"], F.asc("o_orderkey")).where("rank <= 3").select("family", "level", "period", "skill", "o_orderkey", "rank")


@query("SELECT job_family_id, count(DISTINCT record_id) AS valid FROM jobs WHERE quality_score >= 0.7 AND published_at_confidence >= 0.5 AND NOT isnan(published_at_confidence) AND job_family_id NOT IN ('TBD', 'N/A') AND job_family_id IS NOT NULL GROUP BY job_family_id")
def valid_unique(s, d):
    ok = "quality_score >= 0.7 AND published_at_confidence >= 0.5 AND NOT isnan(published_at_confidence) AND job_family_id NOT IN ('TBD', 'N/A')"
    return jobs(s, d).where(ok).groupBy("job_family_id").agg(F.count_distinct("record_id").alias("valid"))


@query("""SELECT account_id, row_id, received_at, max(received_at) OVER w AS newest FROM boss_jobs WINDOW w AS (PARTITION BY account_id ORDER BY file_no, line_number, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY received_at < max(received_at) OVER w""")
def late_lines(s, d):
    """Lines of files that arrived after a later file of their account; none is dropped."""
    w = Window.partitionBy("account_id").orderBy(F.asc_nulls_last("file_no"), F.asc_nulls_last("line_number"), "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "boss_jobs").select("account_id", "row_id", "received_at", F.max("received_at").over(w).alias("newest")).where("received_at < newest")


@query("WITH u AS (SELECT DISTINCT region AS place, 'jobs' AS held_in FROM jobs WHERE region IS NOT NULL UNION ALL SELECT DISTINCT unnest(LocNames), 'beisen_list' FROM beisen_list) SELECT place, count(*) AS tables_, min(held_in) AS first_table FROM u WHERE place IS NOT NULL GROUP BY place")
def places_anywhere(s, d):
    """A union of columns of different tables."""
    a = jobs(s, d).where("region IS NOT NULL").select(F.col("region").alias("place"), F.lit("jobs").alias("held_in")).distinct()
    b = table(s, d, "beisen_list").select(F.explode("LocNames").alias("place"), F.lit("beisen_list").alias("held_in")).distinct()
    return a.unionByName(b).where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("tables_"), F.min("held_in").alias("first_table"))


_JLEX = f"""{_LEX}, jh AS (SELECT row_id, job_description_raw AS text, name, category, alias, instr(lower(job_description_raw), alias) AS pos FROM jobs, lex WHERE contains(lower(job_description_raw), alias)),
 jb AS (SELECT * FROM jh QUALIFY row_number() OVER (PARTITION BY row_id, name ORDER BY pos, -length(alias)) = 1), je AS (SELECT row_id, name, category, trim({_SIDE}, ' ' || chr(9) || chr(10) || chr(13)) AS evidence, CASE WHEN alias = lower(name) THEN 92 ELSE 86 END AS conf FROM jb),
 js AS (SELECT row_id, name, category, conf, regexp_matches(lower(evidence), '{"|".join(lexicon.PREFERRED)}') AS wish FROM je)"""
_SCORE_SQL = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {round(v * 100)}" for k, v in record_queries.SOURCE_SCORES.items()) + " ELSE 65 END"
_KNOWN = "NOT IN ('', 'unknown', '未知')"


def posting_skills(s: SparkSession, d: str) -> DataFrame:
    """A row per posting and skill its text names."""
    return jobs(s, d).select("row_id", F.inline(lexicon.mentions(F.col("job_description_raw")))).select("row_id", "name", "category", F.round(F.col("confidence") * 100).cast("bigint").alias("conf"), (F.col("requirement") == "preferred").alias("wish"))


@query(f"""WITH {_JLEX}, x AS (SELECT job_family_id AS family, name, js.row_id, conf * {_SCORE_SQL} AS weight, wish, lower(trim(source_type)) AS kind, lower(trim(source_name)) AS source, lower(trim(company_name)) AS company, first_seen_at FROM js JOIN jobs USING (row_id) WHERE job_family_id IS NOT NULL), n AS (SELECT job_family_id AS family, count(*) AS n FROM jobs GROUP BY ALL),
 g AS (SELECT family, name, count(*) AS evidence, sum(weight)::BIGINT AS weight, count(*) FILTER (NOT wish) AS required, count(DISTINCT CASE WHEN kind {_KNOWN} THEN kind END) AS kinds, count(DISTINCT CASE WHEN source {_KNOWN} THEN source END) AS sources, count(DISTINCT CASE WHEN company {_KNOWN} THEN company END) AS companies, min(first_seen_at) AS first_at, max(first_seen_at) AS last_at FROM x GROUP BY family, name)
 SELECT family, name, evidence, round(evidence / n, 4) AS prevalence, CASE WHEN 2 * required >= evidence THEN 'required' ELSE 'preferred' END AS requirement, round(required / evidence, 4) AS required_ratio, kinds, sources, companies, first_at, last_at, CASE WHEN kinds >= 2 OR sources >= 3 THEN 'confirmed' ELSE 'single_source' END AS status,
  CASE WHEN kinds >= 2 OR sources >= 3 THEN (weight // evidence)::DOUBLE / 10000 ELSE least((weight // evidence)::DOUBLE / 10000, 0.6999) END AS confidence FROM g JOIN n USING (family)""")
def job_skill_evidence(s, d):
    """The evidence for each skill of each family: postings, sources, companies, times, how far sources confirm each other; one source alone never makes high confidence."""
    kinds = F.create_map(*[F.lit(x) for k, v in record_queries.SOURCE_SCORES.items() for x in (k, round(v * 100))])
    known = lambda c: F.when(~F.lower(strip(F.col(c))).isin("", "unknown", "未知"), F.lower(strip(F.col(c))))
    j = jobs(s, d).where("job_family_id IS NOT NULL").select("row_id", F.col("job_family_id").alias("family"), F.coalesce(kinds[F.col("source_type")], F.lit(65)).alias("trust"), known("source_type").alias("kind"), known("source_name").alias("source"), known("company_name").alias("company"), "first_seen_at")
    x = posting_skills(s, d).join(j, "row_id")
    g = x.groupBy("family", "name").agg(
        F.count("*").alias("evidence"), F.sum(F.col("conf") * F.col("trust")).alias("weight"), F.count_if(~F.col("wish")).alias("required"), F.count_distinct("kind").alias("kinds"),
        F.count_distinct("source").alias("sources"), F.count_distinct("company").alias("companies"), F.min("first_seen_at").alias("first_at"), F.max("first_seen_at").alias("last_at"),
    ).join(j.groupBy("family").agg(F.count("*").alias("n")), "family")
    confirmed = (F.col("kinds") >= 2) | (F.col("sources") >= 3)
    mean = F.floor(F.col("weight") / F.col("evidence")) / 10_000.0
    return g.select(
        "family", "name", "evidence", F.round(F.col("evidence") / F.col("n"), 4).alias("prevalence"), F.when(2 * F.col("required") >= F.col("evidence"), "required").otherwise("preferred").alias("requirement"),
        F.round(F.col("required") / F.col("evidence"), 4).alias("required_ratio"), "kinds", "sources", "companies", "first_at", "last_at", F.when(confirmed, "confirmed").otherwise("single_source").alias("status"),
        F.when(confirmed, mean).otherwise(F.least(mean, F.lit(0.6999))).alias("confidence"),
    )


@query("""WITH m AS (SELECT max(batch_no) // 2 AS half FROM jobs), g AS (SELECT job_family_id AS family, count(*) FILTER (batch_no > half) AS now_n, count(*) FILTER (batch_no <= half) AS old_n, count(DISTINCT source_type) AS sources, count(DISTINCT batch_no) AS batches FROM jobs, m WHERE job_family_id IS NOT NULL GROUP BY ALL)
 SELECT family, now_n, old_n, CASE WHEN now_n <= 0 THEN 0.0 ELSE round(0.35 * least(greatest(0, (now_n - old_n) / greatest(old_n, 1)) / 2, 1) + 0.20 * least(sources / 5, 1) + 0.25 * CASE WHEN old_n = 0 THEN 0.9 ELSE 0.3 END + 0.10 * least(batches / 2, 1) + 0.10 * least(now_n / 30, 1), 4) END AS score FROM g""")
def family_emergence(s, d):
    """How far each family is emerging: growth, sources, novelty, persistence and volume."""
    j = s.sql("SELECT job_family_id AS family, source_type, batch_no, batch_no > (SELECT max(batch_no) div 2 FROM {j}) AS late FROM {j} WHERE job_family_id IS NOT NULL", j=jobs(s, d).select("job_family_id", "source_type", "batch_no"))
    g = j.groupBy("family").agg(F.count_if("late").alias("now_n"), F.count_if(~F.col("late")).alias("old_n"), F.count_distinct("source_type").alias("sources"), F.count_distinct("batch_no").alias("batches"))
    one = lambda c: F.least(c, F.lit(1.0))
    growth = F.greatest(F.lit(0.0), (F.col("now_n") - F.col("old_n")) / F.greatest(F.col("old_n"), F.lit(1)))
    score = 0.35 * one(growth / 2) + 0.20 * one(F.col("sources") / 5) + 0.25 * F.when(F.col("old_n") == 0, 0.9).otherwise(0.3) + 0.10 * one(F.col("batches") / 2) + 0.10 * one(F.col("now_n") / 30)
    return g.select("family", "now_n", "old_n", F.when(F.col("now_n") <= 0, 0.0).otherwise(F.round(score, 4)).alias("score"))


@query(f"WITH {_JLEX} SELECT row_id, array_to_string(list_sort(list(name || CASE WHEN wish THEN '?' ELSE '' END)), ',') AS skills, count(*) AS n FROM js GROUP BY row_id")
def nested_skills(s, d):
    """The skills of each posting, nested in its row; no shuffle, as they come from one text."""
    m = lexicon.mentions(F.col("job_description_raw"))
    names = F.array_sort(F.transform(m, lambda x: F.concat(x["name"], F.when(x["requirement"] == "preferred", "?").otherwise(""))))
    x = jobs(s, d).select("row_id", names.alias("k")).where(F.size("k") > 0)
    return x.select("row_id", F.array_join("k", ",").alias("skills"), F.size("k").cast("bigint").alias("n"))


@query("SELECT row_id, account_id, row_number() OVER (PARTITION BY account_id, file_no ORDER BY line_number NULLS LAST, row_id) AS line, count(*) OVER (PARTITION BY account_id, file_no) AS lines FROM liepin_jobs")
def line_numbers(s, d):
    """Lines numbered within their file."""
    w = Window.partitionBy("account_id", "file_no")
    order = w.orderBy(F.asc_nulls_last("line_number"), "row_id")
    return table(s, d, "liepin_jobs").select("row_id", "account_id", F.row_number().over(order).alias("line"), F.count("*").over(w).alias("lines"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS INTEGER), -1) AS k, coalesce(json_valid(props), false) AS readable FROM events")
def json_fallback(s, d):
    """A value out of JSON, or a default where there is none."""
    e = table(s, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"), F.expr("coalesce(try_parse_json(props) IS NOT NULL, false)").alias("readable"))


@query("SELECT row_id, job_family_id FROM jobs WHERE job_family_id IS NULL OR job_family_id NOT IN (SELECT job_family_id FROM job_family WHERE job_family_id IS NOT NULL)")
def outside_families(s, d):
    """Rows whose family is not among the known ones; a row without one is outside too."""
    j = jobs(s, d).select("row_id", "job_family_id")
    return j.join(table(s, d, "job_family").select("job_family_id"), "job_family_id", "left_anti").select("row_id", "job_family_id")


@query(f"""WITH c AS ({O["capability_keys"]}) SELECT row_id, array_to_string(list_filter([CASE WHEN length(trim(industry)) > 80 OR regexp_matches(industry, '\\d+(?:\\.\\d+)?\\s*[-—~至]\\s*\\d+(?:\\.\\d+)?\\s*(?:元|[kK万])|本科|硕士|大专|学历|岗位要求|职位要求|招聘') THEN 'suspicious_industry' END,
 CASE WHEN NOT has_evidence THEN 'no_capability_evidence' END, CASE WHEN coalesce(quality_score, 0) < 0.7 THEN 'low_quality_score' END], lambda x: x IS NOT NULL), ',') AS findings FROM jobs JOIN c USING (row_id)""")
def soft_findings(s, d):
    """What a person should look at in a row."""
    odd = F.coalesce((F.length(F.trim("industry")) > 80) | F.col("industry").rlike(r"\d+(?:\.\d+)?\s*[-—~至]\s*\d+(?:\.\d+)?\s*(?:元|[kK万])|本科|硕士|大专|学历|岗位要求|职位要求|招聘"), F.lit(False))
    low = F.lower("job_description_raw")
    some = F.coalesce(F.exists(F.array(*[F.lit(a) for _, _, a in lexicon.ALIASES]), lambda a: F.contains(low, a)) | F.col("job_description_raw").rlike("|".join(lexicon.RESPONSIBLE)), F.lit(False))
    codes = F.array(F.when(odd, "suspicious_industry"), F.when(~some, "no_capability_evidence"), F.when(F.coalesce("quality_score", F.lit(0.0)) < 0.7, "low_quality_score"))
    return jobs(s, d).select("row_id", F.array_join(F.array_compact(codes), ",").alias("findings"))


@query(f"""WITH f AS ({O["requirement_forms"]}), t AS ({O["title_forms"]}), q AS ({record_queries.O["quality_score"]}), g AS ({record_queries.O["quality_gate"]})
 SELECT j.row_id, t.title, f.education, f.experience, f.pay, f.region, q.score, g.status, sha256(translate(regexp_replace(lower(job_description_raw), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '和及与', '')) AS content FROM jobs j JOIN f USING (row_id) JOIN q USING (row_id) JOIN g USING (row_id) LEFT JOIN t ON t.row_id = j.row_id""")
def prepared_records(s, d):
    """Rows in the one schema: normal forms, score, findings and the hash of the wording, composed of the queries that make each."""
    known = table(s, d, "job_family").select("job_family_id", "family_name")
    base = jobs(s, d)
    kinds = F.create_map(*[F.lit(x) for kv in record_queries.SOURCE_SCORES.items() for x in kv])
    filled = sum(((F.coalesce(c, F.lit("")) != "").cast("int") for c in record_queries._COMPLETE[1:]), (F.coalesce(record_queries._COMPLETE[0], F.lit("")) != "").cast("int"))
    size = F.least(F.coalesce(F.length("job_description_raw"), F.lit(0)) / 500, F.lit(1.0))
    x = base.join(known, "job_family_id", "left").select(
        "row_id", F.when(F.col("job_title_raw").isNotNull(), F.coalesce("family_name", fields.title(F.col("job_title_raw")))).alias("title"), fields.education(F.col("education_requirement")).alias("education"),
        fields.experience(F.col("experience_requirement")).alias("experience"), fields.pay_text(F.col("salary_range")).alias("pay"), fields.region(F.col("region")).alias("region"),
        F.round(0.45 * F.coalesce(kinds[F.col("source_type")], F.lit(0.65)) + 0.30 * filled / 6 + 0.25 * size, 4).alias("score"), F.sha2(fields.wording(F.col("job_description_raw")), 256).alias("content"),
    )
    return x.join(record_queries.Q["quality_gate"](s, d).select("row_id", "status"), "row_id")


@query()
def inline_text(s, d):
    """Titles and places in one line of unified forms."""
    return jobs(s, d).select("row_id", fields.inline("job_title_raw").alias("title"), fields.inline("region").alias("region"))


@query()
def page_text(s, d):
    """Readable text of documents with markup."""
    return table(s, d, "documents").where(F.contains("text", F.lit("<"))).select("doc_id", fields.readable("text").alias("text"))


QUERIES, ORACLE = Q, O
