"""Instants written in many notations and zones, as whole milliseconds since 1970-01-01 UTC.

``to_instants`` recognises the notations by one regular expression each, rewrites the fields into
one canonical string, and resolves the zone: an offset, an abbreviation or a zone named in the value
itself, else the zone the row states, else the zone estimated for the row's clock by
``estimate_zones``. All of it runs in the JVM; no shuffle is needed unless zones are estimated.

A value that is null, empty, not a time, relative or impossible, or that is a wall time which its
zone skips or has twice, has a null ``epoch_ms``; a day alone is its first moment. Unknown zone names
count as missing. Repeated rows and ties are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.plan import settled
from skein.functions.text import narrow, strip

_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_DAYTIME = "上午|下午|凌晨|中午|早上|清晨|傍晚|晚上"
# Each notation, and its fields as year|month|day|hour|minute|second|fraction|half of day|zone.
NOTATIONS: list[tuple[str, str]] = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]\s*{_HMS})?\s*(?:([AaPp][Mm])\b)?\s*([^\d].*)?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||"),
    (r"^((?:19|20)\d{2})(\d{2})(\d{2})$", "$1|$2|$3||||||"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(?:({_DAYTIME})?\s*(\d{{1,2}})[点时:](\d{{1,2}})?(?:分|:)?(?:(\d{{1,2}})秒?)?)?$", "$1|$2|$3|$5|$6|$7||$4|"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_HMS})?$", "$3|$2|$1|$4|$5|$6|$7||"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_HMS}\s*([AaPp][Mm])$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
    (rf"^{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_HMS}\s*([AaPp][Mm])?)?$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
    (rf"^(\d{{1,2}})-{_MON}-(\d{{4}})(?:\s+{_HMS})?$", "$3|$2|$1|$4|$5|$6|$7||"),
    (rf"^(?:[A-Z][a-z]{{2}},\s*)?(\d{{1,2}})\s+{_MON}\s+(\d{{4}})\s+{_HMS}\s*(.*)$", "$3|$2|$1|$4|$5|$6|$7||$8"),
]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: Minutes east of UTC. Abbreviations that several zones share are only listed for one family below.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "北京时间": 480, "北京時間": 480,
}
#: Shared abbreviations: (zone prefix of the row, minutes); without such a zone they say nothing.
SHARED = {"CST": [("Asia/", 480), ("America/", -360)], "IST": [("Asia/Kolkata", 330), ("Europe/Dublin", 60), ("Asia/Jerusalem", 120)]}
DAY = 86_400


def known_zones(df: DataFrame) -> list[str]:
    """The zone names this JVM knows (a fixed list of some 600)."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def _offset(seconds: Column, zone: Column) -> Column:
    """Seconds east of UTC of ``zone`` at an instant, in any session zone."""
    t = F.timestamp_seconds(seconds)
    return F.unix_seconds(F.from_utc_timestamp(t, zone)) - seconds


def wall_to_utc(wall: Column, zone: Column) -> Column:
    """struct(utc, ambiguous, skipped, first) for wall-clock seconds (counted as if UTC) in a zone.

    The offsets a day before and a day after are the only ones the wall time can have; an offset
    holds if it is the one in force at the instant it leads to. ``first`` is the instant by the
    earlier offset, which for a day's midnight is the day's first moment.
    """
    before, after = _offset(wall - DAY, zone), _offset(wall + DAY, zone)
    a, b = wall - before, wall - after
    holds_a, holds_b = _offset(a, zone) == before, _offset(b, zone) == after
    two = (before != after) & holds_a & holds_b
    none = ~holds_a & ~holds_b
    return F.struct(
        F.when(~two & ~none, F.when(holds_a, a).otherwise(b)).alias("utc"), two.alias("ambiguous"), none.alias("skipped"),
        F.when(holds_a | none, a).otherwise(b).alias("first"),
    )


def parse(df: DataFrame, value: str, zone: str, zones: list[str] | None = None) -> DataFrame:
    """``df`` with ``__wall`` (seconds as if UTC), ``__ms`` (milliseconds within the second),
    ``__minutes`` (offset stated in the value), ``__zone`` (zone to apply), ``__day`` (a day alone)
    and ``__epoch`` (milliseconds, for values that are counters since 1970)."""
    zones = zones or known_zones(df)
    s = strip(narrow(F.col(value).cast("string")))
    canon = F.lit(None).cast("string")
    for pattern, fields in reversed(NOTATIONS):
        canon = F.when(F.col("__s").rlike(pattern), F.regexp_replace("__s", pattern, fields)).otherwise(canon)
    number = F.col("__s").try_cast("bigint")
    epoch = (
        F.when(F.col("__s").rlike(r"^\d{10}$"), number * 1000)
        .when(F.col("__s").rlike(r"^\d{13}$"), number)
        .when(F.col("__s").rlike(r"^\d{16}$"), F.floor(number / 1000))
    ).cast("bigint")
    out = df.withColumn("__s", s).withColumn("__epoch", epoch).withColumn("__p", F.split(canon, r"\|"))
    part = lambda i: F.nullif(F.col("__p")[i], F.lit(""))
    month = F.coalesce(part(1).try_cast("int"), F.expr("nullif(array_position(array(" + ",".join(f"'{m}'" for m in MONTHS) + "), __p[1]), 0)").cast("int"))
    hour, half = part(3).try_cast("int"), F.upper(part(7))
    twelve = F.when((hour >= 1) & (hour <= 12), hour % 12)
    hour = (
        F.when(half.isNull(), hour)
        .when(half == "AM", twelve)
        .when(half == "PM", twelve + 12)
        .when(half.isin("上午", "早上", "清晨", "凌晨"), F.when((half == "凌晨") & (hour == 12), 0).when(hour <= 12, hour))
        .when(half == "中午", F.when(hour.between(11, 12), hour).when(hour.between(1, 2), hour + 12))
        .when(hour.between(1, 11), hour + 12)
        .when(hour.between(12, 23), hour)
    )
    day = part(3).isNull()
    minute, second = F.coalesce(part(4).try_cast("int"), F.lit(0)), F.coalesce(part(5).try_cast("int"), F.lit(0))
    date = F.try_make_timestamp_ntz(part(0).try_cast("int"), month, part(2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    legal = day | ((hour <= 23) & (minute <= 59) & (second <= 59))
    wall = F.when(legal, F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY + F.when(day, 0).otherwise(hour * 3600 + minute * 60 + second))
    ms = F.coalesce(F.rpad(part(6), 3, "0").substr(1, 3).try_cast("int"), F.lit(0))
    tail = F.regexp_replace(F.coalesce(part(8), F.lit("")), r"^[\s(]+|[\s)]+$", "")
    sign = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?:\[.*\])?$"
    g = lambda i: F.nullif(F.regexp_extract("__tail", sign, i), F.lit(""))
    size = g(2).try_cast("int") * 60 + F.coalesce(g(3).try_cast("int"), F.lit(0))
    stated = F.when((size <= 18 * 60) & (F.coalesce(g(3).try_cast("int"), F.lit(0)) < 60), F.when(g(1) == "-", -size).otherwise(size))
    named = F.regexp_extract("__tail", r"^\[([A-Za-z_/+\-0-9]+)\]$", 1)
    short = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])[F.upper("__tail")]
    own = F.when(F.col(zone).isin(zones), F.col(zone))
    for k, families in SHARED.items():
        for prefix, minutes in families:
            short = F.coalesce(short, F.when((F.upper("__tail") == k) & own.startswith(prefix), F.lit(minutes)))
    out = out.withColumn("__tail", tail)
    bad = (F.col("__tail") != "") & stated.isNull() & short.isNull() & ~F.coalesce(named.isin(zones), F.lit(False))
    return settled(out, df.columns, {
        "__epoch": F.col("__epoch"), "__wall": F.when(~bad, wall), "__ms": ms, "__minutes": F.coalesce(stated, short),
        "__zone": F.when(named.isin(zones), named).otherwise(own), "__day": day,
    })


def to_instants(df: DataFrame, value: str, zone: str, zones: list[str] | None = None, estimated: DataFrame | None = None, clock: str | None = None) -> DataFrame:
    """``df`` with ``epoch_ms`` (bigint, null where undeterminable).

    ``estimated`` (clock, zone), as ``estimate_zones`` gives it, serves rows without a usable zone.
    """
    p = parse(df, value, zone, zones)
    if estimated is not None:
        p = p.join(estimated.select(F.col("clock").alias(clock), F.col("zone").alias("__guess")), clock, "left")
        p = p.withColumn("__zone", F.coalesce("__zone", "__guess")).drop("__guess")
    p = p.withColumn("__u", F.when(F.col("__minutes").isNull() & F.col("__zone").isNotNull(), wall_to_utc(F.col("__wall"), F.coalesce("__zone", F.lit("UTC")))))
    seconds = F.when(F.col("__minutes").isNotNull(), F.col("__wall") - F.col("__minutes") * 60).otherwise(
        F.when(F.col("__day"), F.col("__u.first")).otherwise(F.col("__u.utc"))
    )
    return settled(p, df.columns, {"epoch_ms": F.coalesce("__epoch", (seconds * 1000 + F.col("__ms")).cast("bigint"))})


#: One zone for each offset history in wide use, by which unknown clocks are tried.
CANDIDATES = [
    "Pacific/Honolulu", "America/Anchorage", "America/Los_Angeles", "America/Phoenix", "America/Denver", "America/Chicago", "America/Mexico_City", "America/New_York",
    "America/Bogota", "America/Halifax", "America/Caracas", "America/Santiago", "America/St_Johns", "America/Sao_Paulo", "Atlantic/Azores", "UTC", "Europe/London", "Africa/Lagos",
    "Europe/Berlin", "Africa/Johannesburg", "Europe/Athens", "Africa/Cairo", "Europe/Moscow", "Africa/Nairobi", "Asia/Tehran", "Asia/Dubai", "Asia/Kabul", "Asia/Karachi", "Asia/Kolkata",
    "Asia/Kathmandu", "Asia/Dhaka", "Asia/Yangon", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Darwin", "Australia/Adelaide", "Australia/Brisbane", "Australia/Sydney",
    "Pacific/Auckland",
]
#: Local lags are compared in quarters of an hour, of which every offset in use is a multiple.
QUARTER = 900
#: Share of a clock's rows that must be ingested within an hour for lags alone to tell its zone.
NEAR = 0.05


def estimate_zones(df: DataFrame, value: str, seen: str, clock: str, candidates: list[str] | None = None, max_lag_days: int = 60) -> DataFrame:
    """The zone of each clock, from rows whose zone is not stated: (clock, zone, n, violations).

    ``seen`` is the row's time of ingestion (epoch seconds). Under each candidate's offset history a row
    without an offset is a violation if its wall time is one the zone skips, if it lies after its ingestion, or more
    than ``max_lag_days`` before it; a row that does state an offset (other than by Z, UTC or GMT, which any clock may write)
    is one if the candidate had another offset then. The history with the fewest violations is chosen;
    histories that agree at all times observed are one, named by the first candidate. Where different ones tie, the
    one under which most rows were ingested within an hour is chosen if those are NEAR of the rows or more: then
    a clock an hour further west would be in the future. Else the rows do not tell the zone, and it is null (undetermined).

    Rows are counted per clock, hour and quarter of an hour of lag before any candidate is tried, so
    a clock with a third of all rows is no larger a task than another, and repeated rows cost nothing.
    """
    candidates = sorted(candidates or CANDIDATES)
    rows = df.select(F.col(clock).alias("clock"), F.col(value).alias("v"), F.col(seen).cast("bigint").alias("seen"), F.lit(None).cast("string").alias("z"))
    p = parse(rows, "v", "z").where("__wall IS NOT NULL AND __zone IS NULL AND NOT __day AND clock IS NOT NULL")
    edge = 16 * 4  # beyond sixteen hours no offset makes a difference
    lag = F.floor((F.col("seen") - F.col("__wall")) / QUARTER)
    late = (F.col("seen") - F.col("__wall")) > max_lag_days * DAY
    facts = p.where(F.col("__minutes").isNull() | (F.col("__minutes") != 0) | ~F.col("v").rlike(r"(?i)(?:Z|UTC|GMT)[)\s]*$")).select(
        "clock", F.floor(F.col("__wall") / 3600).alias("hour"), F.col("__minutes").alias("minutes"),
        F.when(F.col("__minutes").isNull(), F.when(late, edge + 1).otherwise(F.least(lag, F.lit(edge)))).cast("int").alias("lag"),
    ).where("minutes IS NOT NULL OR lag IS NOT NULL").groupBy("clock", "hour", "minutes", "lag").agg(F.count("*").alias("n"))
    tried = facts.withColumn("zone", F.explode(F.array(*[F.lit(c) for c in candidates])))
    wall = F.col("hour") * 3600 + 1800
    tried = tried.withColumn("u", wall_to_utc(wall, F.col("zone")))
    offset = wall - F.col("u.first")
    own = F.when(F.col("minutes").isNotNull(), F.col("minutes") * 60 != offset).otherwise(
        F.col("u.skipped") | (F.col("lag") > edge) | (F.col("lag") + F.floor(offset / QUARTER) < 0)
    )
    # The hours at which a zone was observed, with its offset there, tell histories apart.
    history = F.sum(F.pmod(F.xxhash64("hour", offset), F.lit(1 << 40)))
    soon = F.col("minutes").isNull() & (F.col("lag") + F.floor(offset / QUARTER)).between(0, 3)
    votes = tried.groupBy("clock", "zone").agg(
        F.sum("n").alias("n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("violations"), F.sum(F.when(soon, F.col("n")).otherwise(0)).alias("soon"), history.alias("history")
    )
    best = votes.groupBy("clock").agg(F.min("violations").alias("violations"))
    one = votes.join(best, ["clock", "violations"]).groupBy("clock", "violations", "history").agg(F.max("n").alias("n"), F.min("zone").alias("zone"), F.max("soon").alias("soon"))
    tied = one.groupBy("clock", "violations").agg(F.max("n").alias("n"), F.max_by("zone", F.struct("soon", "zone")).alias("zone"), F.max("soon").alias("soon"), F.count("*").alias("histories"))
    told = (F.col("histories") == 1) | (F.col("soon") >= F.greatest(F.lit(3.0), NEAR * F.col("n")))
    return tied.select("clock", F.when(told, F.col("zone")).alias("zone"), "n", "violations")


def instants_of(df: DataFrame, value: str, zone: str, clock: str, seen: str, candidates: list[str] | None = None) -> DataFrame:
    """``df`` with ``epoch_ms``: each row by its own offset or zone, and rows of no usable zone by the zone that is
    estimated for their clock. Only those rows, and no others, pay for the estimate; where there are none it is not planned."""
    zones = known_zones(df)
    usable = F.coalesce(F.col(zone).isin(zones), F.lit(False))
    lacking = df.where(~usable)
    if lacking.isEmpty():
        return to_instants(df, value, zone, zones)
    guessed = estimate_zones(lacking, value, seen, clock, candidates)
    own = to_instants(df.where(usable), value, zone, zones)
    return own.unionByName(to_instants(lacking, value, zone, zones, guessed, clock))
