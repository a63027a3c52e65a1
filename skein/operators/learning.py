"""What to learn for a profile, in which order, and what it would bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.lexicon import PREREQUISITES, closure

PHASES = {"prerequisite": 1, "core": 2, "required": 2, "preferred": 3}


def foundations(spark: SparkSession) -> DataFrame:
    """(skill, needs, step): the closure of the prerequisites, foundations first; a fixed small table."""
    names = {*PREREQUISITES, *(x for v in PREREQUISITES.values() for x in v)}
    rows = [(s, n, i) for s in sorted(names) for i, n in enumerate(closure(s))]
    return spark.createDataFrame(rows, "skill string, needs string, step int")


def plan(gaps: DataFrame, owned: DataFrame, scores: DataFrame, needs: DataFrame) -> DataFrame:
    """(cand, profile, phase, place, skill, priority, uplift, projected) of ``gaps`` (cand, profile, skill, priority, uplift);
    ``uplift`` is in ten-thousandths of a point, whole, so sums do not depend on their order.

    A skill that is missing twice is one, of the higher priority and uplift. What a gap builds on comes before it, unless the
    candidate (``owned``: cand, skill) has it. Phases are foundations, what the profile asks for, what it prefers; ``place`` is the
    order within all. ``projected`` is the score (``scores``: cand, profile, total in hundredths) after each step, 100 at most.
    """
    from pyspark.sql import Window

    rank = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    one = gaps.groupBy("cand", "profile", "skill").agg(F.max_by("priority", -rank[F.col("priority")]).alias("priority"), F.max("uplift").alias("uplift"))
    base = one.join(needs, "skill").select("cand", "profile", F.col("needs").alias("skill"), "step")
    base = base.join(owned.select("cand", "skill"), ["cand", "skill"], "left_anti").join(one.select("cand", "profile", "skill"), ["cand", "profile", "skill"], "left_anti")
    base = base.groupBy("cand", "profile", "skill").agg(F.min("step").alias("step")).select("cand", "profile", "skill", F.lit("prerequisite").alias("priority"), F.lit(0).cast("bigint").alias("uplift"), "step")
    every = base.unionByName(one.withColumn("step", F.lit(0))).withColumn("phase", rank[F.col("priority")])
    order = Window.partitionBy("cand", "profile").orderBy("phase", F.when(F.col("priority") == "core", 0).otherwise(1), "step", F.desc("uplift"), "skill")
    gained = F.sum("uplift").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = every.withColumns({"place": F.row_number().over(order), "gained": gained}).join(scores.select("cand", "profile", "total"), ["cand", "profile"])
    return out.select("cand", "profile", "phase", "place", "skill", "priority", "uplift", (F.least(F.lit(10_000), F.floor((F.col("total") * 100 + F.col("gained") + 50) / 100)) / 100).alias("projected"))
