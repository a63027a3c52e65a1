"""Customers as candidates against profiles of their segment: (segment, priority) with the brands ordered there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import learning, matching
from skein.plans.profile_queries import postings
from skein.session import materialise
from skein.sources.tables import table

#: Years a priority stands for, and brands that stand in for each other.
YEARS = {"1-URGENT": 8, "2-HIGH": 5, "3-MEDIUM": 3, "4-NOT SPECIFIED": 0, "5-LOW": 0}
RELATED = [("Brand#1", "Brand#2"), ("Brand#2", "Brand#1"), ("Brand#10", "Brand#11"), ("Brand#11", "Brand#10")]

BASE = f"""WITH p AS (SELECT o_orderkey, o_custkey, c_mktsegment || '|' || o_orderpriority AS profile, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
 l AS (SELECT l_orderkey AS o_orderkey, p_brand AS skill, p_type AS item, l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey), now AS (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) AS now FROM lineitem),
 held AS (SELECT o_custkey AS cand, skill, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS have, bool_or(l_linestatus = 'F') AS project, bool_or(l_linestatus = 'O') AS work, bool_or(l_quantity > 48) AS achieved, max(year(l_shipdate) * 12 + month(l_shipdate)) AS month
  FROM p JOIN l USING (o_orderkey) GROUP BY o_custkey, skill),
 rel(have_, want) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RELATED)}), stands AS (SELECT DISTINCT cand, want AS skill FROM held JOIN rel ON skill = have_),
 once AS (SELECT profile, o_orderkey, skill, max((l_returnflag = 'R')::INT) AS r FROM p JOIN l USING (o_orderkey) GROUP BY ALL), n AS (SELECT profile, count(*) AS n FROM p GROUP BY profile),
 t AS (SELECT profile, skill, 2 * sum(r) >= count(*) AS required, round(count(*) / any_value(n), 4) AS prevalence FROM once JOIN n USING (profile) GROUP BY profile, skill),
 prof AS (SELECT profile, n, CASE split_part(profile, '|', 2) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in YEARS.items())} END AS asked FROM n),
 du AS (SELECT profile, item FROM (SELECT profile, item, count(*) AS c FROM p JOIN l USING (o_orderkey) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY profile ORDER BY c DESC, item) <= 3), did AS (SELECT DISTINCT o_custkey AS cand, item FROM p JOIN l USING (o_orderkey)),
 cand AS (SELECT o_custkey AS cand, max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS own, any_value(split_part(profile, '|', 1)) AS seg FROM p GROUP BY o_custkey), pairs AS (SELECT cand, profile, own, asked, n FROM cand JOIN prof ON split_part(profile, '|', 1) = seg),
 w AS (SELECT pairs.cand, pairs.profile, t.skill, required, CASE WHEN prevalence >= 0.25 THEN 3 ELSE 2 END AS rank, prevalence, have, project, work, achieved, month, stands.skill IS NOT NULL AS st, (SELECT now FROM now) - month AS age FROM pairs JOIN t USING (profile) LEFT JOIN held ON held.cand = pairs.cand AND held.skill = t.skill LEFT JOIN stands ON stands.cand = pairs.cand AND stands.skill = t.skill),
 m AS (SELECT cand, profile, count(*) FILTER (required) AS n_req, count(*) FILTER (NOT required) AS n_pref, count(*) FILTER (required AND have IS NOT NULL) AS exact, count(*) FILTER (NOT required AND have IS NOT NULL) AS exact_pref, count(*) FILTER (required AND have IS NULL AND st) AS near, count(*) FILTER (NOT required AND have IS NULL AND st) AS near_pref,
  coalesce(sum(CASE WHEN required THEN round(least(coalesce(have, 0) / rank, 1.0) * 10000) END), 0) AS skilled, coalesce(sum(CASE WHEN required THEN CASE WHEN project THEN 10 WHEN work THEN 6 ELSE 0 END END), 0) AS proof, coalesce(bool_or(required AND achieved), false) AS bonus,
  count(*) FILTER (required AND age BETWEEN 0 AND 24) AS recent, count(*) FILTER (required AND have IS NULL AND prevalence >= 0.65) AS core_missing, count(*) FILTER (required AND (project OR work)) AS strong FROM w GROUP BY cand, profile),
 d AS (SELECT pairs.cand, pairs.profile, count(*) AS n_duties, count(did.item) AS did FROM pairs JOIN du USING (profile) LEFT JOIN did ON did.cand = pairs.cand AND did.item = du.item GROUP BY ALL),
 z AS (SELECT pairs.cand, pairs.profile, own, asked, n, m.* EXCLUDE (cand, profile), n_duties, did FROM pairs JOIN m USING (cand, profile) JOIN d USING (cand, profile)),
 s AS (SELECT *, [round(CASE WHEN n_req > 0 THEN (exact + 0.4 * near) / n_req ELSE 1 END * 3000)::BIGINT, round(CASE WHEN n_req > 0 THEN (skilled / 10000) / n_req ELSE 1 END * 1500)::BIGINT, round(CASE WHEN asked > 0 THEN least(own / asked, 1.0) ELSE 1 END * 1500)::BIGINT,
  round(least(CASE WHEN n_req > 0 THEN (proof / 10) / n_req ELSE 1 END + CASE WHEN bonus AND n_req > 0 THEN 0.1 ELSE 0 END, 1.0) * 1500)::BIGINT, round(CASE WHEN n_req > 0 THEN recent / n_req ELSE 1 END * 1000)::BIGINT, round(CASE WHEN n_pref > 0 THEN (exact_pref + 0.4 * near_pref) / n_pref ELSE 1 END * 500)::BIGINT, round(did / n_duties * 1000)::BIGINT] AS raw,
  CASE WHEN n_req > 0 AND exact / n_req < 0.5 THEN 5900 WHEN core_missing > 0 THEN 7900 ELSE 10000 END AS cap FROM z),
 c AS (SELECT *, CASE WHEN list_sum(raw) <= cap THEN raw ELSE list_transform(raw, lambda x: round(x * cap / list_sum(raw))::BIGINT) END AS sc FROM s),
 f AS (SELECT cand, profile, exact, n_req AS n_required, CASE WHEN list_sum(raw) <= cap THEN sc ELSE list_transform(sc, lambda x, i: CASE WHEN i = list_position(sc, list_max(sc)) THEN x + (cap - list_sum(sc))::BIGINT ELSE x END) END AS v,
  CASE WHEN strong + exact = 0 THEN 'low' WHEN n < 20 THEN 'medium' WHEN n_req = 0 OR strong / n_req >= 0.5 THEN 'high' ELSE 'medium' END AS confidence FROM c),
 scored AS (SELECT cand, profile, v[1]::BIGINT AS required, v[2]::BIGINT AS proficiency, v[3]::BIGINT AS experience, v[4]::BIGINT AS evidence, v[5]::BIGINT AS recency, v[6]::BIGINT AS preferred, v[7]::BIGINT AS duties, list_sum(v)::BIGINT AS total, exact, n_required, confidence,
  CASE WHEN list_sum(v) >= 8000 THEN 'high' WHEN list_sum(v) >= 6000 THEN 'medium' ELSE 'low' END AS band FROM f)"""


def _tables(s: SparkSession, d: str) -> dict:
    """The inputs of ``matching.score``."""
    p = postings(s, d).select("o_orderkey", F.col("o_custkey").alias("cand"), F.col("family"), F.concat_ws("|", "family", "level").alias("profile"), "level", "o_orderdate")
    month = lambda c: F.year(c) * 12 + F.month(c)
    li = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    li = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("skill"), F.col("p_type").alias("item"), "l_returnflag", "l_linestatus", "l_quantity", month("l_shipdate").alias("month"))
    # One joined pass over the lines, reduced to what each use needs.
    both = p.select("o_orderkey", "cand", "profile").join(li, "o_orderkey")
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    skills = both.groupBy("cand", "skill").agg(
        F.max(rank).alias("rank"), F.bool_or(F.col("l_linestatus") == "F").alias("project"), F.bool_or(F.col("l_linestatus") == "O").alias("work"), F.bool_or(F.col("l_quantity") > 48).alias("achieved"), F.max("month").alias("month")
    )
    sizes = p.groupBy("profile", "family", "level").agg(F.count("*").alias("n"))
    once = both.groupBy("profile", "o_orderkey", "skill").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    targets = once.groupBy("profile", "skill").agg(F.count("*").alias("evidence"), F.sum("r").alias("r")).join(sizes.select("profile", "n"), "profile")
    targets = targets.select("profile", "skill", (2 * F.col("r") >= F.col("evidence")).alias("required"), F.round(F.col("evidence") / F.col("n"), 4).alias("prevalence")).withColumn("rank", F.when(F.col("prevalence") >= 0.25, 3).otherwise(2))
    years = F.create_map(*[F.lit(x) for kv in YEARS.items() for x in kv])
    profiles = sizes.select("profile", years[F.col("level")].alias("years"), F.lit(1.0).alias("sure"), (F.col("n") >= 20).alias("ready"))
    counts = both.groupBy("profile", "item").agg(F.count("*").alias("c"))
    from skein.operators.retrieval import rank_within

    duties = rank_within(counts, ["profile"], F.desc("c"), F.asc("item"), name="r").where("r <= 3").select("profile", "item")
    done = both.select("cand", "item").distinct()
    candidates = p.groupBy("cand").agg((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate")) + 1).alias("years"), F.max("family").alias("family"))
    pairs = candidates.select("cand", "family").join(sizes.select("family", "profile"), "family").select("cand", "profile")
    related = s.createDataFrame(RELATED, "have string, want string")
    now = table(s, d, "lineitem").agg(month(F.max("l_shipdate")).alias("now")).first()["now"]
    return {
        "pairs": pairs, "candidates": candidates.select("cand", "years"), "skills": skills, "profiles": profiles, "targets": targets, "duties": duties, "done": done, "related": related, "now": now,
    }


def _scored(s: SparkSession, d: str) -> DataFrame:
    return matching.score(**_tables(s, d))


#: What a brand builds on, in order.
NEEDS = [("Brand#3", "Brand#1", 0), ("Brand#3", "Brand#2", 1), ("Brand#13", "Brand#12", 0)]


def learning_plan(s, d):
    """What each candidate lacks for each profile of the segment, in the order to learn it, with the score it leads to."""
    t = _tables(s, d)
    want = t["pairs"].join(t["targets"], "profile")
    sizes = t["targets"].groupBy("profile").agg(F.count_if("required").alias("n_req"), F.count_if(~F.col("required")).alias("n_pref"))
    owned = t["skills"].select("cand", "skill")
    gaps = want.join(owned, ["cand", "skill"], "left_anti").join(sizes, "profile")
    priority = F.when(F.col("required") & (F.col("prevalence") >= matching.CORE), "core").when(F.col("required"), "required").otherwise("preferred")
    uplift = F.when(F.col("required"), F.floor(F.lit(700_000) / F.col("n_req"))).otherwise(F.floor(F.lit(50_000) / F.col("n_pref"))).cast("bigint")
    gaps = gaps.select("cand", "profile", "skill", priority.alias("priority"), uplift.alias("uplift"))
    needs = s.createDataFrame(NEEDS, "skill string, needs string, step int")
    return learning.plan(gaps, owned, matching.score(**t), needs)


def match_dimensions(s, d):
    return _scored(s, d)


def profile_recommendation(s, d):
    """Each candidate's best profiles, one per level."""
    scored = materialise(_scored(s, d), "scored").withColumn("level", F.split("profile", r"\|")[1])
    return matching.recommend(scored, "level", 3).select("cand", "profile", "total", "confidence", "band", "rank")


QUERIES = {"match_dimensions": match_dimensions, "profile_recommendation": profile_recommendation, "learning_plan": learning_plan}
ORACLE = {
    "match_dimensions": BASE + " SELECT * FROM scored",
    "profile_recommendation": BASE + """ SELECT cand, profile, total, confidence, band, row_number() OVER (PARTITION BY cand ORDER BY total DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, exact DESC, profile) AS rank FROM scored
 QUALIFY row_number() OVER (PARTITION BY cand ORDER BY total DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, exact DESC, profile) <= 3""",
    "learning_plan": BASE + f""", needs(skill, needs, step) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in NEEDS)}),
 sz AS (SELECT profile, count(*) FILTER (required) AS n_req, count(*) FILTER (NOT required) AS n_pref FROM t GROUP BY profile),
 gaps AS (SELECT w.cand, w.profile, skill, CASE WHEN required AND prevalence >= 0.65 THEN 'core' WHEN required THEN 'required' ELSE 'preferred' END AS priority, CASE WHEN required THEN 700000 // n_req ELSE 50000 // n_pref END::BIGINT AS uplift FROM w JOIN sz USING (profile) WHERE have IS NULL),
 pre AS (SELECT g.cand, g.profile, n.needs AS skill, min(n.step) AS step FROM gaps g JOIN needs n USING (skill) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.cand = g.cand AND h.skill = n.needs) AND NOT EXISTS (SELECT 1 FROM gaps o WHERE o.cand = g.cand AND o.profile = g.profile AND o.skill = n.needs) GROUP BY ALL),
 every AS (SELECT cand, profile, skill, 'prerequisite' AS priority, 0::BIGINT AS uplift, step FROM pre UNION ALL SELECT *, 0 FROM gaps), ph AS (SELECT *, CASE priority WHEN 'prerequisite' THEN 1 WHEN 'preferred' THEN 3 ELSE 2 END AS phase FROM every),
 placed AS (SELECT *, row_number() OVER o AS place, sum(uplift) OVER (PARTITION BY cand, profile ORDER BY phase, CASE WHEN priority = 'core' THEN 0 ELSE 1 END, step, uplift DESC, skill ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gained FROM ph WINDOW o AS (PARTITION BY cand, profile ORDER BY phase, CASE WHEN priority = 'core' THEN 0 ELSE 1 END, step, uplift DESC, skill))
 SELECT cand, profile, phase, place, skill, priority, uplift, least(10000, (total * 100 + gained + 50) // 100)::DOUBLE / 100 AS projected FROM placed JOIN scored USING (cand, profile)""",
}
