"""Profiles, evolution, evidence and acceptance over orders, lineitems and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.dates import quarter_index, quarter_key
from skein.operators import evaluation, profiles
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


def postings(s: SparkSession, d: str) -> DataFrame:
    """orders as records: family is the customer's segment, level the priority."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("family"), F.col("o_orderpriority").alias("level"), quarter_key(F.col("o_orderdate")).alias("period"),
        quarter_index(F.col("o_orderdate")).alias("qi"), "o_orderdate", "o_totalprice", "o_custkey", "c_nationkey",
    )


def links(s: SparkSession, d: str) -> DataFrame:
    """lineitems as links from a record to an attribute (the part's brand)."""
    li, p = table(s, d, "lineitem"), table(s, d, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("skill"), "l_returnflag", "l_discount", "l_suppkey")


P = """WITH p AS (SELECT o_orderkey, c_mktsegment AS family, o_orderpriority AS level, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS period,
 (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS qi, o_orderdate, o_totalprice, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
 l AS (SELECT l_orderkey AS o_orderkey, p_brand AS skill, l_returnflag, l_discount, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""
RATES = """, n AS (SELECT family, level, qi, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 10),
 r AS (SELECT family, level, qi, skill, count(DISTINCT o_orderkey) AS evidence, any_value(n) AS n, round(count(DISTINCT o_orderkey) / any_value(n), 4) AS rate,
  CASE WHEN 2 * count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) >= count(DISTINCT o_orderkey) THEN 'required' ELSE 'preferred' END AS requirement
  FROM p JOIN l USING (o_orderkey) JOIN n USING (family, level, qi) GROUP BY family, level, qi, skill)"""
EVOLVED = RATES + """, ready AS (SELECT family, level, qi FROM n WHERE n >= 20), pairs AS (SELECT a.* FROM ready a JOIN ready b ON a.family = b.family AND a.level = b.level AND b.qi = a.qi + 1),
 b AS (SELECT r.* FROM r JOIN pairs USING (family, level, qi)), a AS (SELECT r.family, r.level, r.qi - 1 AS qi, skill, rate, evidence, requirement FROM r JOIN pairs x ON r.family = x.family AND r.level = x.level AND r.qi - 1 = x.qi),
 e AS (SELECT coalesce(b.family, a.family) AS family, coalesce(b.level, a.level) AS level, coalesce(b.qi, a.qi) AS qi, coalesce(b.skill, a.skill) AS skill, coalesce(b.rate, 0) AS before, coalesce(a.rate, 0) AS after,
  coalesce(b.evidence, 0) AS ev_before, coalesce(a.evidence, 0) AS ev_after, b.requirement AS req_before, a.requirement AS req_after FROM b FULL JOIN a ON b.family = a.family AND b.level = a.level AND b.qi = a.qi AND b.skill = a.skill),
 c AS (SELECT *, CASE WHEN before < 0.05 AND after >= 0.15 AND round(after - before, 6) >= 0.10 AND ev_after >= 3 THEN 'added' WHEN before >= 0.15 AND after < 0.05 AND round(after - before, 6) <= -0.10 AND ev_before >= 3 THEN 'removed'
  WHEN before >= 0.05 AND after >= 0.05 AND (abs(round(after - before, 6)) >= 0.10 OR (req_before <> req_after AND ev_after >= 3)) THEN 'modified' ELSE 'none' END AS change FROM e)"""


@query(P + " SELECT family, level, period, count(*) AS n, (sum(round(o_totalprice * 100)::BIGINT) // count(*))::DOUBLE / 100 AS mean_measure, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, CASE WHEN count(*) < 10 THEN 'insufficient' WHEN count(*) < 20 THEN 'low_sample' ELSE 'ready' END AS status FROM p GROUP BY family, level, period")
def quarterly_profiles(s, d):
    return profiles.slices(postings(s, d), ["family", "level", "period"], "o_orderkey", "o_totalprice", "o_orderdate")


@query(P + RATES + " SELECT family, level, qi, skill, evidence, n, rate, requirement FROM r")
def slice_skill_prevalence(s, d):
    return profiles.prevalence(postings(s, d), links(s, d), ["family", "level", "qi"], "o_orderkey", "skill", required=F.col("l_returnflag") == "R").select("family", "level", "qi", "skill", "evidence", "n", "rate", "requirement")


def _evolved(s, d):
    r = postings(s, d)
    rates = profiles.prevalence(r, links(s, d), ["family", "level", "qi"], "o_orderkey", "skill", required=F.col("l_returnflag") == "R")
    sizes = r.groupBy("family", "level", "qi").agg(F.count("*").alias("n")).where(F.col("n") >= profiles.READY)
    return profiles.evolve(rates, sizes, ["family", "level"], "qi", "skill")


@query(P + EVOLVED + " SELECT family, level, qi, skill, before, after, ev_before, ev_after, req_before, req_after, change FROM c WHERE change <> 'none'")
def adjacent_evolution(s, d):
    return _evolved(s, d).where("change <> 'none'").select("family", "level", "qi", "skill", "before", "after", "ev_before", "ev_after", "req_before", "req_after", "change")


@query(P + EVOLVED + " SELECT change, count(*) AS n FROM c GROUP BY change")
def evolution_summary(s, d):
    return _evolved(s, d).groupBy("change").agg(F.count("*").alias("n"))


YEARLY = P + """, w AS (SELECT family, year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM p) AS old, o_orderkey FROM p), t AS (SELECT family, count(*) FILTER (old) AS nb, count(*) FILTER (NOT old) AS na FROM w GROUP BY family),
 x AS (SELECT family, skill, count(DISTINCT CASE WHEN old THEN o_orderkey END) AS b, count(DISTINCT CASE WHEN NOT old THEN o_orderkey END) AS a FROM w JOIN l USING (o_orderkey) GROUP BY family, skill),
 y AS (SELECT family, skill, round(b / nb, 4) AS before, round(a / na, 4) AS after FROM x JOIN t USING (family))
 SELECT *, CASE WHEN before < 0.2 AND after >= 0.3 THEN 'added' WHEN before >= 0.3 AND after < 0.15 THEN 'removed' WHEN before >= 0.15 AND after >= 0.15 AND abs(round(after - before, 6)) >= 0.2 THEN 'changed' ELSE 'none' END AS change FROM y"""


@query(YEARLY)
def yearly_window_evolution(s, d):
    p = postings(s, d)
    last = p.agg(F.max(F.year("o_orderdate")).alias("y"))
    w = s.sql("SELECT family, o_orderkey, year(o_orderdate) < (SELECT y FROM {last}) AS old FROM {p}", p=p, last=last)
    t = w.groupBy("family").agg(F.count_if("old").alias("nb"), F.count_if(~F.col("old")).alias("na"))
    once = w.join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    x = once.groupBy("family", "skill").agg(F.count_if("old").alias("b"), F.count_if(~F.col("old")).alias("a")).join(t, "family")
    y = x.select("family", "skill", F.round(F.col("b") / F.col("nb"), 4).alias("before"), F.round(F.col("a") / F.col("na"), 4).alias("after"))
    b, a = F.col("before"), F.col("after")
    kind = F.when((b < 0.2) & (a >= 0.3), "added").when((b >= 0.3) & (a < 0.15), "removed").when((b >= 0.15) & (a >= 0.15) & (F.abs(F.round(a - b, 6)) >= 0.2), "changed").otherwise("none")
    return y.withColumn("change", kind)


@query(P + """, f AS (SELECT family, skill, o_orderkey, max(1 - l_discount) AS conf, max(l_returnflag = 'R') AS req, any_value(o_custkey) AS cust FROM p JOIN l USING (o_orderkey) GROUP BY family, skill, o_orderkey),
 n AS (SELECT family, count(*) AS total FROM p GROUP BY family), k AS (SELECT family, skill, count(DISTINCT s_nationkey) AS sources FROM p JOIN l USING (o_orderkey) JOIN supplier ON l_suppkey = s_suppkey GROUP BY family, skill)
 SELECT family, skill, count(*) AS evidence, round(count(*) / any_value(total), 4) AS rate, count(DISTINCT cust) AS companies, (sum(round(conf * 10000)::BIGINT) // count(*))::DOUBLE / 10000 AS confidence, round(avg(req::INT), 4) AS required_ratio,
  CASE WHEN avg(req::INT) >= 0.5 THEN 'required' ELSE 'preferred' END AS requirement, any_value(sources) >= 3 AS cross_source FROM f JOIN n USING (family) JOIN k USING (family, skill) GROUP BY family, skill""")
def skill_evidence(s, d):
    p, li = postings(s, d), links(s, d)
    joined = p.select("family", "o_orderkey", "o_custkey").join(li, "o_orderkey")
    first = joined.groupBy("family", "skill", "o_orderkey").agg(
        F.max(1 - F.col("l_discount")).alias("conf"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("req"), F.max("o_custkey").alias("cust")
    )
    total = p.groupBy("family").agg(F.count("*").alias("total"))
    sources = joined.join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("family", "skill").agg(F.count_distinct("s_nationkey").alias("sources"))
    g = first.groupBy("family", "skill").agg(F.count("*").alias("evidence"), F.count_distinct("cust").alias("companies"), (F.floor(F.sum(F.round(F.col("conf") * 10000).cast("bigint")) / F.count("*")) / 10000.0).alias("c"), F.avg("req").alias("r"))
    return g.join(total, "family").join(sources, ["family", "skill"]).select(
        "family", "skill", "evidence", F.round(F.col("evidence") / F.col("total"), 4).alias("rate"), "companies", F.col("c").alias("confidence"),
        F.round("r", 4).alias("required_ratio"), F.when(F.col("r") >= 0.5, "required").otherwise("preferred").alias("requirement"), (F.col("sources") >= 3).alias("cross_source"),
    )


@query(P + """, g AS (SELECT skill, count(DISTINCT o_orderkey) AS n, count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT o_custkey) AS cust, count(DISTINCT CASE WHEN year(o_orderdate) >= 2000 THEN o_orderkey END) AS recent FROM p JOIN l USING (o_orderkey) GROUP BY skill)
 SELECT skill, n, round(0.35 * least(recent / n, 1) + 0.20 * least(n / 1000, 1) + 0.25 * least(years / 2, 1) + 0.20 * least(cust / 5, 1), 4) AS score FROM g""")
def emerging_score(s, d):
    once = postings(s, d).join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    g = once.groupBy("skill").agg(F.count("*").alias("n"), F.count_distinct(F.year("o_orderdate")).alias("years"), F.count_distinct("o_custkey").alias("cust"), F.count_if(F.year("o_orderdate") >= 2000).alias("recent"))
    cap = lambda c: F.least(c, F.lit(1.0))
    n = F.col("n")
    return g.select("skill", "n", F.round(0.35 * cap(F.col("recent") / n) + 0.20 * cap(n / 1000) + 0.25 * cap(F.col("years") / 2) + 0.20 * cap(F.col("cust") / 5), 4).alias("score"))


@query(P + """, k AS (SELECT family, qi, count(*) AS n FROM p GROUP BY family, qi) SELECT a.family, count(*) AS ready_periods, count(b.qi) AS adjacent FROM k a LEFT JOIN k b ON a.family = b.family AND b.qi = a.qi + 1 AND b.n >= 20
 WHERE a.n >= 20 GROUP BY a.family HAVING count(*) >= 3""")
def ready_families_adjacent(s, d):
    k = postings(s, d).groupBy("family", "qi").agg(F.count("*").alias("n")).where(F.col("n") >= profiles.READY)
    w = Window.partitionBy("family").orderBy("qi")
    nxt = k.withColumn("next", F.lead("qi").over(w))
    return nxt.groupBy("family").agg(F.count("*").alias("ready_periods"), F.count_if(F.col("next") == F.col("qi") + 1).alias("adjacent")).where("ready_periods >= 3")


@query("""SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O')
 AND EXISTS (SELECT 1 FROM orders o JOIN lineitem ON l_orderkey = o_orderkey WHERE o.o_custkey = c.c_custkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)""")
def complete_profiles_semi(s, d):
    c, o, li, e = (table(s, d, t) for t in ("customer", "orders", "lineitem", "events"))
    has = lambda x, cond: x.join(cond, "c_custkey", "left_semi")
    of = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("c_custkey"))
    returned = o.join(li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    c = has(has(has(c, of("F")), of("O")), returned)
    return has(c, e.select(F.col("user_id").alias("c_custkey"))).select("c_custkey", "c_mktsegment")


@query("""WITH g AS (SELECT o_orderpriority AS level, c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
 SELECT level, max(n) AS largest, min(n) AS smallest, round(max(n) / sum(n), 4) AS share FROM g GROUP BY level""")
def domain_concentration(s, d):
    g = postings(s, d).groupBy("level", "c_nationkey").agg(F.count("*").alias("n"))
    return g.groupBy("level").agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS open_customers,
 count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean_price, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders""")
def data_quality_totals(s, d):
    o = table(s, d, "orders")
    return o.agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("open_customers"), F.count_distinct("o_custkey").alias("customers"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"),
    )


@query(P + """ SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(level) = 0 THEN 'level' ELSE 'year' END AS dimension, coalesce(family, level, y::VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 4) AS share
 FROM (SELECT family, level, year(o_orderdate) AS y FROM p) GROUP BY GROUPING SETS ((family), (level), (y))""")
def coverage_report(s, d):
    p = postings(s, d).select("family", "level", F.year("o_orderdate").cast("string").alias("y"))
    sets = p.groupingSets([["family"], ["level"], ["y"]], "family", "level", "y").agg(F.count("*").alias("n"), F.grouping("family").alias("gf"), F.grouping("level").alias("gl"))
    kind = F.when(F.col("gf") == 0, "family").when(F.col("gl") == 0, "level").otherwise("year")
    out = sets.select(kind.alias("dimension"), F.coalesce("family", "level", "y").alias("value"), "n")
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dimension")), 4))


@query("""WITH m AS (SELECT 'orders' AS metric, count(*)::DOUBLE AS value, 5000.0 AS least FROM orders UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment), 6.0 FROM customer UNION ALL SELECT 'mean_discount', round(avg(l_discount), 6), 0.04 FROM lineitem
 UNION ALL SELECT 'missing', NULL, 1.0) SELECT metric, value, least, CASE WHEN value IS NULL THEN 'not_measured' WHEN value >= least THEN 'passed' ELSE 'failed' END AS status, CASE WHEN value IS NOT NULL THEN round(greatest(least - value, 0), 6) END AS gap FROM m""")
def metric_status(s, d):
    m = table(s, d, "orders").agg(F.count("*").cast("double").alias("value")).select(F.lit("orders").alias("metric"), "value", F.lit(5000.0).alias("least"))
    m = m.unionByName(table(s, d, "customer").agg(F.count_distinct("c_mktsegment").cast("double").alias("value")).select(F.lit("segments").alias("metric"), "value", F.lit(6.0).alias("least")))
    m = m.unionByName(table(s, d, "lineitem").agg(F.round(F.avg("l_discount"), 6).alias("value")).select(F.lit("mean_discount").alias("metric"), "value", F.lit(0.04).alias("least")))
    m = m.unionByName(s.createDataFrame([("missing", None, 1.0)], "metric string, value double, least double"))
    status = F.when(F.col("value").isNull(), "not_measured").when(F.col("value") >= F.col("least"), "passed").otherwise("failed")
    gap = F.when(F.col("value").isNotNull(), F.round(F.greatest(F.col("least") - F.col("value"), F.lit(0.0)), 6))
    return m.select("metric", "value", "least", status.alias("status"), gap.alias("gap"))


@query(P + """, g AS (SELECT family, skill, count(DISTINCT o_orderkey) AS n FROM p JOIN l USING (o_orderkey) GROUP BY family, skill) SELECT family, skill, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, lower(skill), skill) AS rank FROM g
 QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, lower(skill), skill) <= 12""")
def top_attributes(s, d):
    once = postings(s, d).join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    g = once.groupBy("family", "skill").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), F.lower("skill"), "skill")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 12")


# A candidate is a customer's history; a target is a segment's twelve most frequent brands.
MATCH = P + """, g AS (SELECT family, skill, count(DISTINCT o_orderkey) AS n FROM p JOIN l USING (o_orderkey) GROUP BY family, skill), t AS (SELECT family, skill, row_number() OVER (PARTITION BY family ORDER BY n DESC, skill) AS rank FROM g QUALIFY rank <= 12),
 h AS (SELECT o_custkey, skill, count(DISTINCT o_orderkey) AS times FROM p JOIN l USING (o_orderkey) GROUP BY o_custkey, skill),
 m AS (SELECT h.o_custkey, t.family, count(*) AS have, sum(CASE WHEN rank <= 4 THEN 1 ELSE 0 END) AS core, sum(least(times / 3, 1)) AS depth FROM h JOIN t USING (skill) GROUP BY h.o_custkey, t.family),
 sc AS (SELECT o_custkey, family, have::BIGINT AS have, round(least(100, 60.0 * have / 12 + 25.0 * core / 4 + 15.0 * depth / 12), 4) AS score FROM m)"""


def _targets(s, d):
    once = postings(s, d).select("family", "o_orderkey").join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    g = once.groupBy("family", "skill").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "skill")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("family", "skill", "rank")


def _history(s, d):
    once = postings(s, d).select("o_custkey", "o_orderkey").join(links(s, d).select("o_orderkey", "skill").distinct(), "o_orderkey")
    return once.groupBy("o_custkey", "skill").agg(F.count("*").alias("times"))


def _scores(s, d):
    m = _history(s, d).join(_targets(s, d), "skill").groupBy("o_custkey", "family").agg(
        F.count("*").alias("have"), F.sum(F.when(F.col("rank") <= 4, 1).otherwise(0)).alias("core"), F.sum(F.least(F.col("times") / 3, F.lit(1.0))).alias("depth")
    )
    return m.select("o_custkey", "family", "have", F.round(F.least(F.lit(100.0), 60.0 * F.col("have") / 12 + 25.0 * F.col("core") / 4 + 15.0 * F.col("depth") / 12), 4).alias("score"))


@query(MATCH + " SELECT o_custkey, family, have, score FROM sc")
def match_scores(s, d):
    return _scores(s, d)


@query(MATCH + " SELECT o_custkey, family, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, have DESC, family) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, have DESC, family) <= 3")
def topn_recommendation(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), F.desc("have"), "family")
    return _scores(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "family", "score", "rank")


@query(MATCH + " SELECT c_custkey, t.family, count(*) AS missing, min(skill) AS first_missing FROM customer JOIN t ON t.family = c_mktsegment WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o_custkey = c_custkey AND h.skill = t.skill) GROUP BY c_custkey, t.family")
def skill_gaps(s, d):
    want = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("family")).join(_targets(s, d), "family")
    have = _history(s, d).select(F.col("o_custkey").alias("c_custkey"), "skill")
    return want.join(have, ["c_custkey", "skill"], "left_anti").groupBy("c_custkey", "family").agg(F.count("*").alias("missing"), F.min("skill").alias("first_missing"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 0), c AS (SELECT node, needs, 1 AS depth FROM e UNION ALL SELECT c.node, e.needs, c.depth + 1 FROM c JOIN e ON c.needs = e.node)
 SELECT node, needs, depth, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS step FROM c""")
def learning_order(s, d):
    table(s, d, "nation").createOrReplaceTempView("skein_nation")
    c = s.sql("""WITH RECURSIVE e AS (SELECT n_nationkey AS node, n_nationkey DIV 2 AS needs FROM skein_nation WHERE n_nationkey > 0),
      c AS (SELECT node, CAST(needs AS bigint) AS needs, 1 AS depth FROM e UNION ALL SELECT c.node, CAST(e.needs AS bigint), c.depth + 1 FROM c JOIN e ON c.needs = e.node) SELECT node, CAST(needs AS int) AS needs, depth FROM c""")
    return c.withColumn("step", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("depth"))))


SAID = "CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.05 THEN 'R' ELSE 'A' END"
COUNTS = f"""WITH x AS (SELECT l_returnflag AS t, {SAID} AS s FROM lineitem), k AS (SELECT unnest(['A', 'N', 'R']) AS label), c AS (SELECT label, count(*) FILTER (t = label AND s = label) AS tp, count(*) FILTER (t <> label AND s = label) AS fp, count(*) FILTER (t = label AND s <> label) AS fn FROM k, x GROUP BY label)"""


def _predictions(s, d):
    said = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") > 0.05, "R").otherwise("A")
    return evaluation.per_label(table(s, d, "lineitem").select("l_returnflag", said.alias("said")), "l_returnflag", "said")


@query(COUNTS + " SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS p, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS r, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f FROM c")
def prf_micro(s, d):
    t = _predictions(s, d).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return evaluation.f1(t).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


@query(COUNTS + ", m AS (SELECT label, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c) SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f FROM m")
def prf_macro(s, d):
    return evaluation.f1(_predictions(s, d)).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p", "r", "f")])


@query("""WITH x AS (SELECT l_orderkey, floor(l_quantity / 17)::INT AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 17) DESC, l_extendedprice DESC, l_linenumber) AS ideal FROM lineitem),
 g AS (SELECT l_orderkey, sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg, max(CASE WHEN rank = 1 THEN rel END) = max(rel) AS top1, min(CASE WHEN rel > 0 THEN rank END) AS hit FROM x GROUP BY l_orderkey)
 SELECT count(*) AS cases, round(avg(top1::INT), 4) AS top1, round(avg(coalesce(1.0 / hit, 0)), 4) AS mrr, round(avg(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END), 4) AS ndcg FROM g""")
def ndcg_mrr(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 17).cast("int").alias("rel"), "l_extendedprice", "l_linenumber")
    r = evaluation.ranking(li, "l_orderkey", "rel", F.desc("l_extendedprice"), F.asc("l_linenumber"))
    return r.agg(F.count("*").alias("cases"), F.round(F.avg("top1"), 4).alias("top1"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


@query("""SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS label FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region
 UNION ALL SELECT 'brand:' || p_brand, 'brand', p_brand FROM (SELECT DISTINCT p_brand FROM part)""")
def graph_nodes(s, d):
    node = lambda df, kind, key, label: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
    out = node(table(s, d, "customer"), "customer", "c_custkey", "c_name").unionByName(node(table(s, d, "nation"), "nation", "n_nationkey", "n_name"))
    return out.unionByName(node(table(s, d, "region"), "region", "r_regionkey", "r_name")).unionByName(node(table(s, d, "part").select("p_brand").distinct(), "brand", "p_brand", "p_brand"))


@query("""SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'IN' AS type, 1::BIGINT AS weight FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN', 1 FROM nation
 UNION ALL SELECT 'customer:' || o_custkey, 'brand:' || p_brand, 'USES', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand""")
def graph_edges(s, d):
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    one = F.lit(1).cast("bigint").alias("weight")
    a = table(s, d, "customer").select(name("customer", "c_custkey").alias("source"), name("nation", "c_nationkey").alias("target"), F.lit("IN").alias("type"), one)
    b = table(s, d, "nation").select(name("nation", "n_nationkey").alias("source"), name("region", "n_regionkey").alias("target"), F.lit("IN").alias("type"), one)
    uses = links(s, d).join(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey", "skill").agg(F.count("*").alias("weight"))
    return a.unionByName(b).unionByName(uses.select(name("customer", "o_custkey").alias("source"), name("brand", "skill").alias("target"), F.lit("USES").alias("type"), "weight"))


@query(f"WITH m AS ({O['prf_micro']}), k AS (SELECT count(*) AS n FROM lineitem) SELECT n, f, n >= 100 AND f >= 0.9 AS ready, CASE WHEN n < 100 THEN 'too_few_cases' WHEN f < 0.9 THEN 'not_accurate' ELSE 'ready' END AS reason FROM m, k")
def benchmark_readiness(s, d):
    """Whether a benchmark has cases enough, and the predictions are right often enough."""
    m = prf_micro(s, d)
    n = table(s, d, "lineitem").agg(F.count("*").alias("n"))
    x = s.sql("SELECT (SELECT n FROM {n}) AS n, f FROM {m}", n=n, m=m)
    reason = F.when(F.col("n") < 100, "too_few_cases").when(F.col("f") < 0.9, "not_accurate").otherwise("ready")
    return x.select("n", "f", ((F.col("n") >= 100) & (F.col("f") >= 0.9)).alias("ready"), reason.alias("reason"))


QUERIES, ORACLE = Q, O
