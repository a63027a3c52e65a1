"""Pay recorded in different periods, scales and currencies, in yuan per month.

``read`` takes figures and units out of free text or from separate columns. A figure whose own text
names no unit ("44-76") gets one from a calibrated random forest, trained on the records that do
name one, with the unit hidden: it predicts the unit from the figure's magnitude, the width of the
range, the source, the category and what the neighbouring fields say of a unit. Assignments of at
least ``CONFIDENT`` calibrated confidence are converted. An exact check follows: where the record's other
text states a unit in words, that unit holds, whether the forest was unsure or of another mind (``decided_by``
tells the two apart); an unsure assignment without such words goes to review. Confidence is calibrated on held-out
records whose unit is hidden, and for each kind of evidence apart.

A record without figures (null, empty, "negotiable") has decision ``none``. Ties and repeated
records are treated alike; an empty table gives an empty result and trains nothing; other columns
are ignored; texts are searched whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.plan import settled
from skein.functions.text import bare, narrow, squeeze
from skein.session import materialise

#: The classifier is fitted on at most so many labelled records, those of the lowest hash.
TRAIN_ROWS = 6000
CONFIDENT = 0.9
BINS = 20
#: Categories are told apart by as many buckets of their hash.
CATEGORIES = 64
#: The units a bare figure can have: scale, period; the currency is yuan.
UNITS = [("1", "month"), ("1000", "month"), ("10000", "month"), ("10000", "year"), ("1", "year"), ("1", "day"), ("1", "hour"), ("0.01", "month")]

_NUM = r"(\d+(?:\.\d+)?)(万|千|K|W|分)?"
_UNIT = (
    r"年包.{0,4}?万元?|年薪\(?万?\)?|日薪|时薪|月薪|"
    r"(?:万元|千元|人民币元|人民币|元|RMB|CNY|￥|¥|万|千|K|W|分)(?:/(?:月|年|天|日|小时|时|MONTH|YEAR|MO|YR))?"
)
_EVIDENCE = rf"(?:(?<!带)薪[资酬栏水]?|待遇|报酬|单位|PAYUNIT)[^。;、\d\n]{{0,8}}?({_UNIT})"


def plain(c: Column) -> Column:
    """Narrow, upper case, without white space and thousands separators, ranges with a hyphen, and
    numerals such as 两万七 as 2.7万."""
    s = F.upper(squeeze(narrow(c)))
    s = F.regexp_replace(s, r"[~～〜–—―−至到]", "-")
    s = F.regexp_replace(s, r"(?<=\d),(?=\d{3})", "")
    s = F.regexp_replace(s, "([一二两三四五六七八九])万([一二两三四五六七八九])?", "$1.$2万")
    return F.translate(F.regexp_replace(s, r"\.万", "万"), "一二两三四五六七八九", "1223456789")


def period(s: Column) -> Column:
    """hour, day, year or month if the text names one, else null."""
    return (
        F.when(s.rlike("/时|/小时|时薪|每小时|/HOUR|/HR|PERHOUR"), "hour")
        .when(s.rlike("/天|/日|日薪|每天|每日|/DAY|PERDAY"), "day")
        .when(s.rlike("/年|年薪|年包|每年|/YR|/YEAR|PERYEAR"), "year")
        .when(s.rlike("/月|月薪|每月|/MO|PERMONTH"), "month")
    )


def currency(s: Column) -> Column:
    """USD, HKD, EUR or CNY if the text names one, else null."""
    return (
        F.when(s.rlike(r"HK\$|HKD|港"), "HKD")
        .when(s.rlike(r"US\$|USD|美元"), "USD")
        .when(s.rlike("€|EUR|欧元"), "EUR")
        .when(s.rlike("[¥￥元]|RMB|CNY"), "CNY")
    )


def scale(s: Column) -> Column:
    """What one of the figure's units is worth, as text: 10000, 1000, 0.01, else null."""
    return F.when(s.rlike("万|W"), "10000").when(s.rlike("千|K"), "1000").when(s.rlike("分"), "0.01")


def read(df: DataFrame) -> DataFrame:
    """Figures and units of records (table_name, row_key, value, low, high, unit, other, category).

    Adds ``lo`` and ``hi`` as written, ``lo_scale`` and ``hi_scale``, ``period`` and ``currency``
    where named, ``stated`` (the record itself names a unit) and ``ev_scale``, ``ev_period`` (what
    its other text says of one).
    """
    text = F.regexp_replace(plain(F.col("value")), r"[·*×X]\d+薪.*$", "")
    figures = F.regexp_replace("__s", r"HK\$|US\$|USD|HKD|EUR|CNY|RMB|[¥￥€$]", "")
    category = F.pmod(F.xxhash64(bare(F.col("category"))), F.lit(CATEGORIES)).cast("double") if "category" in df.columns else F.lit(0.0)
    d = df.select("table_name", "row_key", "low", "high", "other", text.alias("__s"), plain(F.col("unit")).alias("__unit"), category.alias("category"))
    d = d.withColumn("__f", figures).withColumn("__u", F.concat_ws("", "__s", "__unit"))
    pair = rf"{_NUM}元?-{_NUM}"
    two = F.col("__f").rlike(pair)
    got = lambda p, i: F.nullif(F.regexp_extract("__f", p, i), F.lit(""))
    lo = F.when(two, got(pair, 1)).otherwise(got(_NUM, 1)).try_cast("double")
    hi = F.when(two, got(pair, 3)).otherwise(got(_NUM, 1)).try_cast("double")
    of = lambda c: F.when(c.isin("万", "W"), "10000").when(c.isin("千", "K"), "1000").when(c == "分", "0.01")
    first, second = of(F.when(two, got(pair, 2)).otherwise(got(_NUM, 2))), of(F.when(two, got(pair, 4)).otherwise(got(_NUM, 2)))
    given = F.col("low").isNotNull() | F.col("high").isNotNull()
    unit = scale(F.col("__unit"))
    d = settled(d, ["table_name", "row_key", "other", "category"], {
        "lo": F.when(given, F.coalesce("low", "high")).otherwise(lo), "hi": F.when(given, F.coalesce("high", "low")).otherwise(hi),
        "lo_scale": F.when(given, unit).otherwise(F.coalesce(first, second)), "hi_scale": F.when(given, unit).otherwise(F.coalesce(second, first)),
        "period": period(F.col("__u")), "currency": currency(F.col("__u")),
        "stated": F.coalesce(F.col("__u").rlike(r"[万千KW分元¥￥€$年月天日时]|USD|HKD|EUR|RMB|CNY|/MO|/YR"), F.lit(False)),
    })
    # The other text is searched only where the figure itself names no unit.
    said = F.array_join(F.transform("other", lambda x: F.upper(squeeze(narrow(x)))), "\n")
    found = F.when(F.col("lo").isNotNull() & ~F.col("stated"), F.nullif(F.regexp_extract(said, _EVIDENCE, 1), F.lit("")))
    kept = [c for c in d.columns if c != "other"]
    d = settled(d, kept, {"__e": found})
    e = F.col("__e")
    return d.select(
        *kept, F.when(e.isNotNull(), F.coalesce(scale(e), F.lit("1"))).alias("ev_scale"), F.when(e.isNotNull(), F.coalesce(period(e), F.lit("month"))).alias("ev_period")
    )


def _unit_index(s: Column, p: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, (a, b) in enumerate(UNITS) for x in (f"{a}|{b}", float(i))])[F.concat_ws("|", s, p)]


def _features(d: DataFrame) -> DataFrame:
    """Magnitude, width of the range, halves, source and evidence, assembled in one vector."""
    code = lambda c, names: F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + 1.0)])[c]
    d = d.select(
        "*",
        F.log10(F.greatest(F.col("lo") + F.col("hi"), F.lit(1e-6)) / 2).alias("f_size"),
        F.log10(F.greatest("hi", F.lit(1e-6)) / F.greatest("lo", F.lit(1e-6))).alias("f_width"),
        F.when((F.col("lo") == F.floor("lo")) & (F.col("hi") == F.floor("hi")), 0.0).otherwise(1.0).alias("f_part"),
        F.coalesce(code(F.col("table_name"), ["jobs", "lagou_jobs", "jobs_list"]), F.lit(0.0)).alias("f_source"),
        F.coalesce("category", F.lit(0.0)).alias("f_category"),
        F.coalesce(code(F.col("ev_scale"), ["1", "1000", "10000", "0.01"]), F.lit(0.0)).alias("f_scale"),
        F.coalesce(code(F.col("ev_period"), ["month", "year", "day", "hour"]), F.lit(0.0)).alias("f_period"),
    )
    cols = ["f_size", "f_width", "f_part", "f_source", "f_category", "f_scale", "f_period"]
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(d)


def monotone(points: list[tuple[float, float]]) -> list[float]:
    """Pool adjacent violators: the rising step function nearest to (weight, value) points."""
    blocks: list[list[float]] = []
    for w, v in points:
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            w0 = w1 + w2
            blocks.append([w0, (w1 * v1 + w2 * v2) / w0 if w0 else max(v1, v2), n1 + n2])
    return [v for _, v, n in blocks for _ in range(int(n))]


def _sample(labelled: DataFrame) -> DataFrame:
    """The training sample: every record twice, with its unit as evidence (as other text would state it) and without.
    Seven tenths by hash are ``fit``, the rest is held out."""
    key = F.xxhash64("table_name", "row_key")
    sample = labelled.withColumn("h", key).orderBy("h", "table_name", "row_key").limit(TRAIN_ROWS)
    told = sample.withColumns({"ev_scale": F.col("lo_scale"), "ev_period": F.col("period"), "told": F.lit(True)})
    blind = sample.withColumns({"ev_scale": F.lit(None).cast("string"), "ev_period": F.lit(None).cast("string"), "told": F.lit(False)})
    return _features(told.unionByName(blind)).select("told", (F.pmod("h", F.lit(10)) < 7).alias("fit"), "label", "features")


def _forest(data: DataFrame):
    return RandomForestClassifier(numTrees=12, maxDepth=8, maxBins=64, seed=7, labelCol="label", featuresCol="features").fit(data.where("fit"))


def fit(labelled: DataFrame):
    """(model, calibration by evidence and confidence bin) from records with a known unit, or None without any.

    The calibration is the share of right predictions of held-out records per bin of confidence, made
    monotone; records with and without evidence have one each, so the easy do not lend confidence to the hard.
    """
    data = materialise(_sample(labelled).coalesce(2), "sample")
    if data.where("fit").isEmpty():
        return None
    model = _forest(data)
    held = _confidence(model.transform(data.where("NOT fit")))
    rows = held.groupBy("told", F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right")
    )
    seen = {(r["told"], r["bin"]): (float(r["n"]), r["right"]) for r in rows.collect()}
    return model, {told: monotone([seen.get((told, b), (0.0, (b + 0.5) / BINS)) for b in range(BINS)]) for told in (False, True)}


def held_out(df: DataFrame) -> DataFrame:
    """(unit, n, right): per unit the held-out records whose unit was hidden without any evidence, and how many the forest got right."""
    data = materialise(_sample(_labelled(materialise(read(df), "pay"))).coalesce(2), "sample")
    names = F.array(*[F.lit(f"{a}|{b}") for a, b in UNITS])
    blank = df.sparkSession.createDataFrame([], "unit string, n bigint, right bigint")
    if data.where("fit").isEmpty():
        return blank
    held = _forest(data).transform(data.where("NOT fit AND NOT told"))
    return held.groupBy(names[F.col("label").cast("int")].alias("unit")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))


def _confidence(d: DataFrame) -> DataFrame:
    return d.withColumn("confidence", F.array_max(vector_to_array("probability")))


def _labelled(d: DataFrame) -> DataFrame:
    """Records of ``read`` that state a unit in yuan, with its ``label``."""
    same = F.coalesce(F.col("lo_scale"), F.lit("1")) == F.coalesce(F.col("hi_scale"), F.lit("1"))
    own = d.where(F.col("lo").isNotNull() & F.col("stated") & same & (F.coalesce("currency", F.lit("CNY")) == "CNY"))
    own = own.withColumns({"lo_scale": F.coalesce("lo_scale", F.lit("1")), "period": F.coalesce("period", F.lit("month"))})
    return own.withColumn("label", _unit_index(F.col("lo_scale"), F.col("period"))).where("label IS NOT NULL")


def to_monthly(df: DataFrame, pay_unit: DataFrame) -> DataFrame:
    """Every record with ``decision`` (converted, review, none), ``low_yuan``, ``high_yuan``, and for
    bare figures ``predicted`` (scale|period), ``confidence``, ``said`` (the unit in other text) and ``decided_by`` (forest, text)."""
    d = materialise(read(df), "pay")
    has = F.col("lo").isNotNull()
    explicit = d.where(has & F.col("stated"))
    bare_ = d.where(has & ~F.col("stated"))
    fitted = fit(_labelled(d))
    none = F.lit(None)
    blank = {"predicted": none.cast("string"), "confidence": none.cast("double"), "said": none.cast("string"), "decided_by": none.cast("string")}
    explicit = explicit.withColumns(blank | {"decision": F.lit("converted")})
    names = F.array(*[F.lit(f"{a}|{b}") for a, b in UNITS])
    if fitted is None:
        bare_ = bare_.withColumns({"predicted": none.cast("string"), "confidence": none.cast("double")})
    else:
        model, steps = fitted
        step = lambda told: F.array(*[F.lit(float(x)) for x in steps[told]])[F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1)).cast("int")]
        level = F.when(F.col("ev_scale").isNotNull(), step(True)).otherwise(step(False))
        bare_ = _confidence(model.transform(_features(bare_))).withColumn("predicted", names[F.col("prediction").cast("int")]).withColumn("confidence", level)
    bare_ = bare_.withColumn("said", F.when(F.col("ev_scale").isNotNull(), F.concat_ws("|", "ev_scale", "ev_period")))
    sure = F.coalesce((F.col("confidence") >= CONFIDENT) & (F.col("said").isNull() | (F.col("said") == F.col("predicted"))), F.lit(False))
    bare_ = bare_.withColumn("decided_by", F.when(sure, "forest").when(F.col("said").isNotNull(), "text"))
    bare_ = bare_.withColumn("__unit", F.when(F.col("decided_by") == "forest", F.col("predicted")).otherwise(F.col("said")))
    bare_ = bare_.withColumn("decision", F.when(F.col("__unit").isNotNull(), "converted").otherwise("review"))
    part = lambda i: F.split("__unit", r"\|")[i]
    bare_ = bare_.withColumns({"lo_scale": part(0), "hi_scale": part(0), "period": part(1)}).select(explicit.columns)
    empty = d.where(~has).withColumns(blank | {"decision": F.lit("none")})
    out = explicit.unionByName(bare_).unionByName(empty)
    periods = pay_unit.where("kind = 'period'").select(F.col("unit_code").alias("__p"), F.col("factor").alias("per_month"))
    money = pay_unit.where("kind = 'currency'").select(F.col("unit_code").alias("__c"), F.col("factor").alias("in_yuan"))
    out = out.join(periods, F.coalesce("period", F.lit("month")) == F.col("__p"), "left").join(money, F.coalesce("currency", F.lit("CNY")) == F.col("__c"), "left")
    yuan = lambda v, s: F.col(v) * F.coalesce(F.col(s), F.lit("1")).cast("double") * F.col("per_month") * F.col("in_yuan")
    a, b = F.round(yuan("lo", "lo_scale")).cast("bigint"), F.round(yuan("hi", "hi_scale")).cast("bigint")
    paid = F.col("decision") == "converted"
    return out.select(
        "table_name", "row_key", "decision", F.when(paid, F.least(a, b)).alias("low_yuan"), F.when(paid, F.greatest(a, b)).alias("high_yuan"),
        F.col("lo").alias("low"), F.col("hi").alias("high"), "predicted", "confidence", "said", "decided_by",
    )
