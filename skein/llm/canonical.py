"""Free-typed values mapped to the entries of a reference list.

Values are deduplicated, normalised and cut into character n-grams; an inverted index over the
reference list's n-grams, written once, gives the candidates, which a weighted cosine scores. A value is accepted if
its best entry scores ``THRESHOLD`` and beats the next entry by ``MARGIN``; the others are unmatched.
The index goes to every worker up to SENT_ROWS rows; a larger one is shuffled.

Nulls are left out; empty values are unmatched; repeated values are scored once; an empty reference
list leaves all values unmatched; ties between entries leave a value unmatched.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import narrow, strip
from skein.session import materialise

THRESHOLD = 0.345
MARGIN = 0.03
#: Codes of up to so many letters and digits are matched whole: one sign more or less is another code.
CODE_LENGTH = 4
#: Rows of the index, some 60 bytes each, up to which it is broadcast.
SENT_ROWS = 1 << 18

# What people put around a title, a place or a family without changing what is meant.
_AROUND = [
    r"^(?:【[^】]*】|\[[^\]]*\]|\([^)]*\)|[★☆※*#·\s])+|(?:【[^】]*】|\[[^\]]*\]|\([^)]*\)|[★☆※*#\s])+$",
    r"^(?:诚聘|急聘|招聘|高薪|资深|高级|中级|初级|首席|见习|实习|助理)+(?=.{2})",
    r"(?i)^(?:senior|junior|lead|principal|staff|chief|sr\.?|jr\.?)\s+",
    r"(?i)\s+[PTMJ]\d{1,5}$",
]
_PLACE = [r"^中国[-·\s]*", r"(?i),\s*china$|\s+city$", r"·.*$", r"(?<=.{2})市区$|(?<=.{2})市$", r"(?<=.{2})[省市](?=.)"]
# Jocular names of trades.
_SLANG = {"攻城狮": "工程师", "程序猿": "程序员", "程序媛": "程序员", "码农": "程序员", "射鸡师": "设计师", "产品汪": "产品经理", "运营喵": "运营"}


@cache
def simplified() -> tuple[str, str]:
    """The traditional characters of the basic block and their simplified forms, by the transliterator that comes with the JVM's Unicode library."""
    rule = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    found = rule.transliterate("\n".join(chars)).split("\n")
    pairs = [(a, b) for a, b in zip(chars, found, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalise(c: Column, kind: str) -> Column:
    """Narrow, simplified and lower case, without trimmings; underscores and hyphens of codes become spaces."""
    s = F.translate(strip(narrow(c)), *simplified())
    for k, v in _SLANG.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    for p in _AROUND + (_PLACE if kind == "place" else []):
        s = strip(F.regexp_replace(s, p, ""))
    s = F.lower(F.regexp_replace(s, r"[_\-–—]+", " "))
    return F.regexp_replace(s, r"[^\p{L}\p{N}/ ]+", "")


def forms(c: Column, kind: str, around: list[str]) -> Column:
    """The forms of a value that may match: whole, and each side of a slash; and without a name of
    ``around`` after it (text: the city of "-珠海") or before it (places: the province)."""
    s = normalise(c, kind)
    each = F.transform(F.array_append(F.split(s, "/"), s), lambda x: F.regexp_replace(x, "[/ ]+", ""))
    if around:
        names = "|".join(around)
        cut = f"^(?:{names})(?=.{{2}})" if kind == "place" else f"(?<=.{{3}})(?:{names})$"
        each = F.concat(each, F.transform(each, lambda x: F.regexp_replace(x, cut, "")))
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def grams(s: Column) -> Column:
    """Han text: characters and marked bigrams. Other text: marked bigrams, trigrams, pairs of
    letters around one other and the sorted letters, which survive swapped letters."""
    t = F.concat(F.lit("^"), s, F.lit("$"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    one = F.filter(F.split(s, ""), lambda x: x != "")
    three = F.filter(cut(3), lambda x: F.length(x) == 3)
    skip = F.transform(three, lambda x: F.concat(F.substring(x, 1, 1), F.lit("_"), F.substring(x, 3, 1)))
    all_of = F.array(F.concat(F.lit("#"), F.array_join(F.array_sort(one), "")))
    return F.array_distinct(F.when(s.rlike(r"\p{IsHan}"), F.concat(one, cut(2))).otherwise(F.concat(cut(2), three, skip, all_of)))


def sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def match(values: DataFrame, reference: DataFrame, kind: str = "text", around: list[str] | None = None) -> DataFrame:
    """(value, ref_id) of each distinct value of ``values.value``; ref_id is NONE where unmatched.

    ``reference`` has (ref_id, surface): every accepted spelling of every entry.
    """
    surfaces = reference.where("surface IS NOT NULL").select("ref_id", F.explode(forms(F.col("surface"), kind, around or [])).alias("form")).distinct()
    index = materialise(surfaces.select("ref_id", "form", F.explode(grams(F.col("form"))).alias("g")), "index")
    n = index.select("ref_id").distinct().count()
    # The rarer an n-gram among the entries, the more it tells them apart; an unknown one weighs most.
    weigh = index.groupBy("g").agg(F.log(1 + F.lit(float(n)) / F.count_distinct("ref_id")).alias("w"))
    whole = Window.partitionBy("ref_id", "form")
    index = materialise(index.join(weigh, "g").withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))), "index")
    weigh = sent(index.select("g", "w").distinct())
    distinct = values.where("value IS NOT NULL").select("value").distinct()
    typed = materialise(distinct.select("value", F.explode(forms(F.col("value"), kind, around or [])).alias("form")), "forms")
    wanted = typed.select("form").distinct().select("form", F.explode(grams(F.col("form"))).alias("g"))
    wanted = wanted.join(weigh, "g", "left").withColumn("w", F.coalesce("w", F.log(1 + F.lit(float(n)))))
    wanted = materialise(wanted, "wanted")
    size = wanted.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    hits = wanted.join(sent(index.select("g", "ref_id", F.col("form").alias("surface"), "norm")), "g")
    dots = hits.groupBy("form", "ref_id", "surface", "norm").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dots.join(size, "form").withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("size")))
    exact = F.col("form") == F.col("surface")
    short = (F.length("surface") <= CODE_LENGTH) & F.col("surface").rlike(r"^[a-z0-9]+$") & ~exact
    best = scored.where(~short).groupBy("form", "ref_id").agg(F.max(F.when(exact, 2.0).otherwise(F.col("cosine"))).alias("cosine"))
    of_value = typed.join(best, "form").groupBy("value", "ref_id").agg(F.max("cosine").alias("cosine"))
    # The two best entries of a value are all that acceptance needs.
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("cosine"), "ref_id"))
    two = of_value.withColumn("r", place).where("r <= 2").groupBy("value").agg(
        F.max(F.when(F.col("r") == 1, F.col("ref_id"))).alias("ref_id"), F.max("cosine").alias("first"), F.max(F.when(F.col("r") == 2, F.col("cosine"))).alias("second")
    )
    accepted = F.when((F.col("first") >= THRESHOLD) & (F.col("first") - F.coalesce("second", F.lit(0.0)) >= MARGIN), F.col("ref_id"))
    return distinct.join(two, "value", "left").select("value", F.coalesce(accepted, F.lit("NONE")).alias("ref_id"))
