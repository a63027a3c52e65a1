"""Versioned aggregates of records: slices, prevalence of attributes, changes between slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_SAMPLE, READY = 10, 20


def sample_status(n: Column) -> Column:
    """insufficient below LOW_SAMPLE, low_sample below READY, else ready."""
    return F.when(n < LOW_SAMPLE, "insufficient").when(n < READY, "low_sample").otherwise("ready")


def slices(records: DataFrame, keys: list[str], record: str, measure: str, time: str) -> DataFrame:
    """Per slice: n, status, mean of ``measure``, first and last ``time``. ``record`` is a key: no two rows share one.

    The mean is of whole hundredths, cut to hundredths: sums of integers do not depend on their order.
    """
    mean = F.floor(F.sum(F.round(F.col(measure) * 100).cast("bigint")) / F.count(measure)) / 100.0
    out = records.groupBy(*keys).agg(
        F.count(record).alias("n"), mean.alias("mean_measure"), F.min(time).alias("first_at"), F.max(time).alias("last_at")
    )
    return out.withColumn("status", sample_status(F.col("n")))


def prevalence(records: DataFrame, links: DataFrame, keys: list[str], record: str, attribute: str, least: int = LOW_SAMPLE, required: Column | None = None) -> DataFrame:
    """Per slice of at least ``least`` records and attribute: evidence, its share of the slice, and ``requirement``
    (required if half of the evidence or more is by a link that ``required`` holds for, else preferred).

    Links are reduced to one per (record, attribute) before the join, so a record linked often
    counts once and the shuffle carries no repeats. ``record`` is a key of ``records``.
    """
    sizes = records.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    once = links.groupBy(record, attribute).agg(F.max(F.coalesce(required, F.lit(False)).cast("int") if required is not None else F.lit(1)).alias("__req"))
    joined = records.select(*keys, record).join(once, record)
    counts = joined.groupBy(*keys, attribute).agg(F.count("*").alias("evidence"), F.sum("__req").alias("__req"))
    counts = counts.withColumn("requirement", F.when(2 * F.col("__req") >= F.col("evidence"), "required").otherwise("preferred")).drop("__req")
    return counts.join(sizes, keys).withColumn("rate", F.round(F.col("evidence") / F.col("n"), 4))


def change_kind(before: Column, after: Column, ev_before: Column, ev_after: Column, req_before: Column | None = None, req_after: Column | None = None, least: int = 3) -> Column:
    """added, removed, modified or none, by rates rounded to four digits and evidence on the changed side. A requirement that
    turns between required and preferred is a modification too."""
    delta = F.round(after - before, 6)
    known = ["required", "preferred"]
    turned = F.lit(False)
    if req_before is not None and req_after is not None:
        turned = F.coalesce(req_before.isin(known) & req_after.isin(known) & (req_before != req_after) & (ev_after >= least), F.lit(False))
    return (
        F.when((before < 0.05) & (after >= 0.15) & (delta >= 0.10) & (ev_after >= least), "added")
        .when((before >= 0.15) & (after < 0.05) & (delta <= -0.10) & (ev_before >= least), "removed")
        .when((before >= 0.05) & (after >= 0.05) & ((F.abs(delta) >= 0.10) | turned), "modified")
        .otherwise("none")
    )


def evolve(rates: DataFrame, ready: DataFrame, keys: list[str], period: str, attribute: str) -> DataFrame:
    """Every attribute's change between a ready slice and the next period's ready slice.

    The rates are computed once: each enters as the state before the next period and as the state after
    the previous one, and one aggregation brings the two together, in place of a full join of two copies.
    """
    here = ready.select(*keys, period, F.lit(1).alias("__r"))
    both = here.unionByName(ready.select(*keys, (F.col(period) - 1).alias(period), F.lit(2).alias("__r")))
    pairs = both.groupBy(*keys, period).agg(F.sum("__r").alias("__r")).where("__r = 3").drop("__r")
    sides = F.inline(F.array(F.struct(F.col(period).alias("__at"), F.lit(True).alias("__old")), F.struct((F.col(period) - 1).alias("__at"), F.lit(False).alias("__old"))))
    twice = rates.select(*keys, attribute, "rate", "evidence", "requirement", sides).withColumnRenamed("__at", period)
    side = lambda old, c, name: F.max(F.when(F.col("__old") == F.lit(old), F.col(c))).alias(name)
    met = twice.join(pairs, [*keys, period], "left_semi").groupBy(*keys, period, attribute).agg(
        side(True, "rate", "before"), side(False, "rate", "after"), side(True, "evidence", "ev_before"), side(False, "evidence", "ev_after"),
        side(True, "requirement", "req_before"), side(False, "requirement", "req_after"),
    )
    met = met.fillna({"before": 0.0, "after": 0.0, "ev_before": 0, "ev_after": 0})
    return met.withColumn("change", change_kind(*[F.col(c) for c in ("before", "after", "ev_before", "ev_after", "req_before", "req_after")]))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in an order that names its tie-breaks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
