"""Capping the rows of dominant contributors by radix selection.

Score and identifier are encoded as 16 order-preserving bytes. Digit by digit, rows are counted per
contributor and digit value; the digit in which the cap falls is fixed, and only the rows that share
the fixed digits are counted further. When a contributor's count meets its cap exactly its cutoff is
known. A last pass compares each row's bytes with its contributor's cutoff.

No group is ever sorted or collected: each pass aggregates (contributor, digit) counts, partially
before the shuffle, so a contributor with a third of all rows costs no more than its digit values.

Null scores rank last; ties go to the lower identifier; rows repeated in all of these tie and are
kept or capped together; a null contributor or cap means no cap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import materialise

#: Hexadecimal digits fixed per pass; 4 are two bytes, so 8 passes fix all 16 bytes.
DIGITS = 4


def order_key(score: Column, row_id: Column) -> Column:
    """32 hexadecimal digits that sort as (score descending, nulls last; row_id ascending).

    The bits of an IEEE double sort like the number if the sign bit is flipped for positive numbers
    and all bits are flipped for negative ones; descending order flips all bits once more.
    """
    # -0.0 is made 0.0; NaN sorts above all numbers, as in SQL.
    value = F.when(score == 0, F.lit(0.0)).otherwise(score)
    exponent = F.floor(F.log2(F.abs(value)))
    exponent = F.when(F.abs(value) < F.pow(F.lit(2.0), exponent), exponent - 1).when(
        F.abs(value) >= F.pow(F.lit(2.0), exponent + 1), exponent + 1
    ).otherwise(exponent)
    exponent = F.greatest(exponent, F.lit(-1022))
    mantissa = F.abs(value) / F.pow(F.lit(2.0), exponent)
    normal = mantissa >= 1
    bits = F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.when(normal, (exponent + 1023)).otherwise(F.lit(0)).cast("bigint") * F.lit(1 << 52)
        + ((mantissa - F.when(normal, 1.0).otherwise(0.0)) * F.lit(float(1 << 52))).cast("bigint")
    )
    bits = F.when(F.isnan(score), F.lit(0x7FF8 << 48)).when(value == float("inf"), F.lit(0x7FF0 << 48)).when(value == float("-inf"), F.lit(0x7FF0 << 48)).otherwise(bits)
    # Descending: larger positive scores get smaller keys, in the lower half; negatives follow.
    key = F.when(score.isNull(), F.lit(-1)).when((value < 0), bits.bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))).otherwise(
        F.lit((1 << 63) - 1).cast("bigint") - bits
    )
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(hexed(key), hexed(row_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))))


def cutoffs(rows: DataFrame) -> DataFrame:
    """(contributor, cutoff) for each contributor with more than ``cap`` rows: the key of its last row
    to keep, digits after the fixed ones filled with F. ``rows`` has contributor, cap, key."""
    totals = rows.groupBy("contributor").agg(F.count("*").alias("n"), F.max("cap").alias("cap"))
    state = materialise(totals.where("n > cap").select(
        "contributor", F.lit("").alias("fixed"), F.col("cap").cast("bigint").alias("left_over"), F.when(F.col("cap") <= 0, F.lit("")).alias("cutoff")
    ), "cap")
    for done in range(0, 32, DIGITS):
        open_ = state.where("cutoff IS NULL")
        if done and open_.isEmpty():
            break
        digit = F.substring("key", done + 1, DIGITS)
        counts = (
            rows.join(open_.select("contributor", "fixed", "left_over"), "contributor")
            .where(F.substring("key", 1, done) == F.col("fixed") if done else F.lit(True))
            .groupBy("contributor", "fixed", "left_over", digit.alias("digit")).agg(F.count("*").alias("n"))
        )
        # The digits of one contributor that still compete, at most 16 ** DIGITS of them.
        step = counts.groupBy("contributor", "fixed", "left_over").agg(F.collect_list(F.struct("digit", "n")).alias("d"))
        fold = F.aggregate(
            F.array_sort("d"),
            F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("string").alias("digit"), F.lit(0).cast("bigint").alias("at")),
            lambda a, x: F.when(a["digit"].isNotNull(), a).otherwise(
                F.struct(
                    F.when(a["before"] + x["n"] >= F.col("left_over"), a["before"]).otherwise(a["before"] + x["n"]).alias("before"),
                    F.when(a["before"] + x["n"] >= F.col("left_over"), x["digit"]).alias("digit"),
                    x["n"].alias("at"),
                )
            ),
        )
        step = step.withColumn("f", fold)
        full = F.col("f.before") + F.col("f.at") == F.col("left_over")
        last = done + DIGITS >= 32
        fixed = F.concat("fixed", "f.digit")
        step = step.select(
            "contributor", fixed.alias("fixed"), (F.col("left_over") - F.col("f.before")).alias("left_over"),
            F.when(full | F.lit(last), F.rpad(fixed, 32, "F")).alias("cutoff"),
        )
        state = materialise(state.where("cutoff IS NOT NULL").unionByName(step), "cap")
    return state.select("contributor", "cutoff")


def surplus(rows: DataFrame) -> DataFrame:
    """The rows beyond their contributor's cap. ``rows`` has row_id, contributor, cap, score.

    Rows whose keys tie at the cutoff (the same score and row_id twice) are kept together.
    """
    keyed = rows.where("contributor IS NOT NULL AND cap IS NOT NULL").select(
        "row_id", "contributor", "cap", order_key(F.col("score"), F.col("row_id")).alias("key")
    )
    keyed = materialise(keyed, "keyed")
    cut = cutoffs(keyed)
    return keyed.join(cut, "contributor").where(F.col("key") > F.col("cutoff")).select("row_id", "contributor")


def host_of(url: Column) -> Column:
    """The lower-case host of an http(s) URL without user, port and final dot, else null."""
    h = F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"\.+$", ""), F.lit(""))


def operators(jobs: DataFrame, source: DataFrame) -> DataFrame:
    """``jobs`` (any columns, with source_url and source_name) plus ``operator``.

    Distinct hosts are matched by their domain suffixes, longest first, before they join the rows.
    """
    j = jobs.withColumn("__host", host_of(F.col("source_url"))).withColumn("__name", F.regexp_replace("source_name", r"(?U)\s+", ""))
    hosts = j.select("__host").where("__host IS NOT NULL").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = source.select(F.lower("source_domain").alias("__domain"), F.col("operator").alias("__by_host"))
    found = hosts.select("__host", F.explode(suffixes).alias("__domain")).join(domains, "__domain")
    found = found.groupBy("__host").agg(F.max_by("__by_host", F.length("__domain")).alias("__by_host"))
    names = source.groupBy(F.regexp_replace("source_name", r"(?U)\s+", "").alias("__name")).agg(F.min("operator").alias("__by_name"))
    j = j.join(found, "__host", "left").join(names, "__name", "left")
    return j.select(*jobs.columns, F.coalesce("__by_host", "__by_name").alias("operator"))
