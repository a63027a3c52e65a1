"""Candidates against profiles in seven dimensions.

All inputs are long tables; nothing is crossed but the pairs the caller names. Scores are whole hundredths, so they
do not depend on the order of sums. A profile without targets of a kind is met in full in its dimension; a
candidate without skills scores by experience alone; repeated skills of one candidate are one, of the highest rank and all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dimensions in order with their weights, years a level asks for, and the limits of the rules.
WEIGHTS = {"required": 30, "proficiency": 15, "experience": 15, "evidence": 15, "recency": 10, "preferred": 5, "duties": 10}
LEVEL_YEARS = {"junior": 0, "mid": 3, "senior": 5, "expert": 8}
RELATED_CREDIT, CORE, WORK_CREDIT, BONUS, RECENT_MONTHS = 0.4, 0.65, 0.6, 0.1, 24


def capped(scores: Column, cap: Column) -> Column:
    """Scores in hundredths whose sum is at most ``cap``: scaled down in proportion, what rounding leaves goes to the first largest."""
    total = F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, x: a + x)
    scaled = F.transform(scores, lambda x: F.round(x * cap / total).cast("bigint"))
    rest = cap - F.aggregate(scaled, F.lit(0).cast("bigint"), lambda a, x: a + x)
    top = F.array_position(scaled, F.array_max(scaled))
    return F.when(total <= cap, scores).otherwise(F.transform(scaled, lambda x, i: F.when(i + 1 == top, x + rest).otherwise(x)))


def band(total: Column) -> Column:
    return F.when(total >= 8000, "high").when(total >= 6000, "medium").otherwise("low")


def score(pairs: DataFrame, candidates: DataFrame, skills: DataFrame, profiles: DataFrame, targets: DataFrame, duties: DataFrame, done: DataFrame, related: DataFrame, now: int) -> DataFrame:
    """(cand, profile, required … duties, total, exact, n_required, confidence, band) of each of ``pairs`` (cand, profile), in hundredths.

    ``candidates`` (cand, years); ``skills`` (cand, skill, rank, project, work, achieved, month); ``profiles`` (profile, years, sure,
    ready); ``targets`` (profile, skill, required, rank, prevalence); ``duties`` (profile, item) and ``done`` (cand, item);
    ``related`` (have, want), both ways; ``now`` and months as year * 12 + month.
    """
    held = skills.groupBy("cand", "skill").agg(
        F.max("rank").alias("have"), F.bool_or("project").alias("project"), F.bool_or("work").alias("work"), F.bool_or("achieved").alias("achieved"), F.max("month").alias("month")
    )
    stands = held.join(related, held["skill"] == related["have"]).select("cand", F.col("want").alias("skill"), F.lit(True).alias("stands")).distinct()
    want = pairs.join(targets, "profile").join(held, ["cand", "skill"], "left").join(stands, ["cand", "skill"], "left")
    req, hit = F.col("required"), F.col("have").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    proof = F.when(F.coalesce("project", F.lit(False)), 1.0).when(F.coalesce("work", F.lit(False)), WORK_CREDIT).otherwise(0.0)
    age = F.lit(now) - F.col("month")
    met = want.groupBy("cand", "profile").agg(
        count(req).alias("n_req"), count(~req).alias("n_pref"), count(req & hit).alias("exact"), count(~req & hit).alias("exact_pref"),
        count(req & ~hit & F.col("stands")).alias("near"), count(~req & ~hit & F.col("stands")).alias("near_pref"),
        F.sum(F.when(req, F.round(F.least(F.coalesce(F.col("have"), F.lit(0)) / F.col("rank"), F.lit(1.0)) * 10_000))).cast("bigint").alias("skilled"),
        F.sum(F.when(req, F.round(proof * 10))).cast("bigint").alias("proof"), F.coalesce(F.bool_or(req & F.col("achieved")), F.lit(False)).alias("bonus"),
        count(req & (age >= 0) & (age <= RECENT_MONTHS)).alias("recent"), count(req & ~hit & (F.col("prevalence") >= CORE)).alias("core_missing"),
        count(req & (F.col("project") | F.col("work"))).alias("strong"),
    )
    tasks = pairs.join(duties, "profile").join(done.distinct().withColumn("did", F.lit(True)), ["cand", "item"], "left")
    tasks = tasks.groupBy("cand", "profile").agg(F.count("*").alias("n_duties"), F.count("did").alias("did"))
    x = pairs.join(met, ["cand", "profile"], "left").join(tasks, ["cand", "profile"], "left").join(candidates.withColumnRenamed("years", "own"), "cand").join(profiles.withColumnRenamed("years", "asked"), "profile").fillna(0)
    share = lambda top, n: F.when(F.col(n) > 0, top / F.col(n)).otherwise(1.0)
    ratios = {
        "required": share(F.col("exact") + RELATED_CREDIT * F.col("near"), "n_req"), "proficiency": share(F.col("skilled") / 10_000, "n_req"),
        "experience": F.when(F.col("asked") > 0, F.least(F.col("own") / F.col("asked"), F.lit(1.0))).otherwise(1.0),
        "evidence": F.least(share(F.col("proof") / 10, "n_req") + F.when(F.coalesce("bonus", F.lit(False)) & (F.col("n_req") > 0), BONUS).otherwise(0.0), F.lit(1.0)),
        "recency": share(F.col("recent"), "n_req"), "preferred": share(F.col("exact_pref") + RELATED_CREDIT * F.col("near_pref"), "n_pref"), "duties": share(F.col("did"), "n_duties"),
    }
    raw = F.array(*[F.round(r * (WEIGHTS[k] * 100)).cast("bigint") for k, r in ratios.items()])
    signal = (F.col("n_req") > 0) | (F.col("n_pref") > 0) | (F.col("n_duties") > 0) | (F.col("asked") > 0)
    half = F.when(F.col("n_req") > 0, F.col("exact") / F.col("n_req")).otherwise(1.0) < 0.5
    cap = F.when(~signal, 0).when(half, 5900).when(F.col("core_missing") > 0, 7900).otherwise(10_000).cast("bigint")
    sure = F.when(~F.col("ready") | (F.col("sure") < 0.6), "medium").when((F.col("n_req") == 0) | (F.col("strong") / F.greatest("n_req", F.lit(1)) >= 0.5), "high").otherwise("medium")
    out = x.select("cand", "profile", capped(raw, cap).alias("s"), "exact", F.col("n_req").alias("n_required"), F.when(F.col("strong") + F.col("exact") == 0, "low").otherwise(sure).alias("confidence"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select("cand", "profile", *[F.col("s")[i].alias(k) for i, k in enumerate(WEIGHTS)], total.alias("total"), "exact", "n_required", "confidence", band(total).alias("band"))


def recommend(scored: DataFrame, family: str, limit: int = 10) -> DataFrame:
    """``scored`` with ``rank``: each candidate's best profile per family, by total, confidence, exact hits and name, ``limit`` of them (1 to 10)."""
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    order = [F.desc("total"), F.desc(sure), F.desc("exact"), F.asc("profile")]
    best = scored.withColumn("__r", F.row_number().over(Window.partitionBy("cand", family).orderBy(*order))).where("__r = 1").drop("__r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("cand").orderBy(*order))).where(F.col("rank") <= max(1, min(limit, 10)))
