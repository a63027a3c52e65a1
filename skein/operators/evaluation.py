"""Accuracy and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_label(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(label, tp, fp, fn) over rows with a true and a predicted label."""
    votes = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("s")), F.struct(F.col(said).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("s")))).alias("v"), (F.col(truth) == F.col(said)).alias("hit"))
    votes = votes.select("v.*", "hit")
    return votes.groupBy("label").agg(
        F.sum(F.when(F.col("hit"), F.col("t")).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(~F.col("hit"), F.col("s")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(~F.col("hit"), F.col("t")).otherwise(0)).cast("bigint").alias("fn"),
    )


def ratio(a, b):
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("p"), r.alias("r")).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def ranking(df: DataFrame, case: str, relevance: str, *order, k: int = 5) -> DataFrame:
    """Per case: top1 (the first is of the highest relevance), reciprocal rank of the first relevant
    item, and NDCG at k."""
    w = Window.partitionBy(case)
    d = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("ideal", F.row_number().over(w.orderBy(F.desc(relevance), *order)))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), relevance) - 1) / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    best = F.max(relevance)
    out = d.groupBy(case).agg(
        gain("rank").alias("dcg"), gain("ideal").alias("idcg"), F.max(F.when(F.col("rank") == 1, F.col(relevance))).alias("first"), best.alias("best"),
        F.min(F.when(F.col(relevance) > 0, F.col("rank"))).alias("hit"),
    )
    return out.select(
        case, (F.col("first") == F.col("best")).cast("int").alias("top1"), F.coalesce(1.0 / F.col("hit"), F.lit(0.0)).alias("rr"), ratio(F.col("dcg"), F.col("idcg")).alias("ndcg")
    )
