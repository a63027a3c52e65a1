"""The family of a posting by the terms of its title and its text, from a table of families' terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.fields import named
from skein.functions.text import narrow


@dataclass(frozen=True)
class Family:
    """What tells a family: terms of titles, of skills, and terms that rule it out; a bounded configuration."""

    code: str
    titles: list[str]
    skills: list[str]
    excluded: list[str] = field(default_factory=list)
    least: float = 0.8


def classify(df: DataFrame, key: str, title: str, text: str, families: list[Family]) -> DataFrame:
    """(key, status, family, confidence, candidates) of each row, in one pass without a shuffle.

    Confidence is .62 and .12 per title term and per skill term (two of each at most); three skill terms without a title
    term count .08 more; each excluded term takes .25 (two at most). One family with evidence, and none other, that is sure
    enough is ``auto``; else the row goes to ``review``. Negated mentions do not count. Null texts have no terms.
    """
    t, x = F.lower(narrow(F.coalesce(title, F.lit("")))), F.lower(narrow(F.coalesce(text, F.lit(""))))
    count = lambda c, terms, no: F.size(F.array_compact(F.array(*[F.when(named(c, w, no), 1) for w in terms]))) if terms else F.lit(0)
    d = df.select(F.col(key).alias("key"), t.alias("t"), x.alias("x"), F.concat_ws("\n", t, x).alias("all"))

    def judged(f: Family) -> Column:
        return F.struct(F.lit(f.code).alias("code"), count(F.col("t"), f.titles, False).alias("t"), count(F.col("x"), f.skills, True).alias("s"), count(F.col("all"), f.excluded, True).alias("e"), F.lit(f.least).alias("least"))

    hits = F.filter(F.array(*[judged(f) for f in families]), lambda h: (h["t"] > 0) | (h["s"] > 0))
    d = d.select("key", F.inline_outer(F.array(F.struct(hits.alias("h")))))

    def scored(h: Column) -> Column:
        only = (h["t"] == 0) & (h["s"] >= 3)
        base = F.least(F.lit(0.98), 0.62 + 0.12 * F.least(h["t"], F.lit(2)) + 0.12 * F.least(h["s"], F.lit(2)))
        sure = F.greatest(F.lit(0.0), F.when(only, F.least(F.lit(0.98), base + 0.08)).otherwise(base) - 0.25 * F.least(h["e"], F.lit(2)))
        ready = ((h["t"] > 0) & (h["s"] > 0)) | only
        return F.struct((-F.round(sure, 3)).alias("minus"), h["code"].alias("code"), ready.alias("ready"), (ready & (sure >= h["least"]) & (h["e"] == 0)).alias("fit"))

    d = d.select("key", F.array_sort(F.transform("h", scored)).alias("h"))
    fit, ready = F.filter("h", lambda h: h["fit"]), F.filter("h", lambda h: h["ready"])
    auto = (F.size(fit) == 1) & (F.size(ready) == 1)
    best = F.coalesce(-F.try_element_at("h", F.lit(1))["minus"], F.lit(0.0))
    return d.select(
        F.col("key").alias(key), F.when(auto, "auto").otherwise("review").alias("status"), F.when(auto, F.try_element_at(fit, F.lit(1))["code"]).alias("family"),
        F.when(auto, -F.try_element_at(fit, F.lit(1))["minus"]).otherwise(F.least(F.lit(0.79), best)).alias("confidence"), F.transform("h", lambda h: h["code"]).alias("candidates"),
    )
