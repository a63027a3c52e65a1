"""Variant spellings of organisations, linked by merge-and-rematch resolution.

Every distinct spelling becomes a profile: the letters its core sounds like, its place, its industry.
Profiles that meet under a blocking key and do not contradict one another merge; the merged profile
unions the spellings and takes over what only some of them state, such as the place, and enters
blocking again under the keys it can form now. This ends when a round merges nothing.

Keys are made of the sorted letters of the core, so homophones, Latin spellings, swapped letters and
swapped syllables meet; of the same without the nasal's g; of the core without one syllable, of any length; of the
initials of a name of several words, for its acronym; of the core's letters without any one of them, for typing errors; and of the place and
the beginning of a core, for names cut short. A
key under which profiles of several places or industries meet says nothing and is passed over. The looser
keys need more: a shorter core joins only if one organisation fits it; an acronym, a mistyped or a shortened name
only if two profiles meet, neither contradicting the other, and one of them is still alone in its spelling, so two
organisations that each have several spellings are never joined by likeness.

Null and empty names are left out; repeated names count once; an empty table gives an empty result.
Profiles are a few columns per distinct name, and keys are aggregated, never collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import discard, materialise

# Industries as they are written in either script, and legal forms.
INDUSTRIES = {
    "微电子": "microelectronics", "信息技术": "infotech", "自动化": "automation", "电子": "electronics", "网络": "network", "数据": "data",
    "科技": "technology", "软件": "software", "通信": "telecom", "物联": "iot", "仪器": "instruments", "智能": "intelligence",
}
LEGAL = re.compile(r"(?:股份有限公司|集团有限公司|有限责任公司|有限公司|集团公司|分公司|集团|公司)$")
LATIN_LEGAL = re.compile(r"(?i)[\s,]*(?:co\.?,?\s*ltd\.?|company limited|ltd\.?|limited|inc\.?|corp\.?|llc|group)\s*$")
#: Readings of name characters where the most common one is another.
READINGS = {"长": "chang", "重": "chong", "乐": "le", "行": "hang", "单": "shan", "厦": "xia", "曾": "zeng", "柏": "bai", "盛": "sheng", "朝": "chao", "都": "du", "藏": "zang", "解": "xie", "翟": "zhai", "尉": "wei"}
#: Letters a core must have for its typing errors to be looked for, and syllables of one that may be cut short.
TYPED, SHORTENED = 8, 4


def readings(spark: SparkSession) -> dict[str, str]:
    """The Latin reading of every Han character of the basic block, by the transliterator that comes
    with the JVM's Unicode library: a table of a fixed 20,992 entries."""
    rule = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    found = rule.transliterate("\n".join(chars)).split("\n")
    return dict(zip(chars, (x.strip() for x in found), strict=True)) | READINGS


def profile(name: str, places: dict[str, str], sounds: dict[str, str]) -> tuple:
    """(han core, syllables, letters, place, industry, initials) of one spelling; ``initials`` are those of three words or more, or a single word in capitals."""
    s = unicodedata.normalize("NFKC", name).strip()
    if any(c in sounds for c in s):
        s = re.sub(r"\s+", "", s)
        place = None
        m = re.fullmatch(r"【(.+)】(.+?)分公司", s)
        if m and (m[2] in places or m[2].removesuffix("市") in places):
            s, place = m[1], places[m[2].removesuffix("市")] if m[2] not in places else places[m[2]]
        for m in re.finditer(r"[(（]([^)）]+)[)）]", s):
            if m[1].removesuffix("市") in places:
                place = places[m[1].removesuffix("市")]
        s = LEGAL.sub("", re.sub(r"[(（][^)）]*[)）]|[【】]", "", s))
        industry = next((i for i in INDUSTRIES if s.endswith(i) and len(s) > len(i)), None)
        core = s.removesuffix(industry) if industry else s
        if place is None:
            for p in sorted((p for p in places if core.startswith(p) and p[0] in sounds), key=len, reverse=True):
                rest = core[len(p) :].removeprefix("市")
                if len(rest) >= 3 or (len(core) != 4 and len(rest) >= 2):
                    core, place = rest, places[p]
                break
        syllables = [sounds.get(c, c.lower()) for c in core]
        return core, syllables, "".join(syllables), place, industry, None
    place = None
    m = re.search(r"[,(]\s*([A-Za-z' ]+?)\s*\)?\s*$", s)
    if m and re.sub(r"[^a-z]", "", m[1].lower()) in places:
        place, s = places[re.sub(r"[^a-z]", "", m[1].lower())], s[: m.start()]
    s = LATIN_LEGAL.sub("", s)
    tokens = re.findall(r"[A-Za-z0-9]+", s)
    back = {v: k for k, v in INDUSTRIES.items()}
    sorted_back = {"".join(sorted(v)): k for k, v in INDUSTRIES.items()}
    industry = None
    if len(tokens) > 2 and tokens[1].lower() == "of" and tokens[0].lower() in back:
        industry, tokens = back[tokens[0].lower()], tokens[2:]
    elif len(tokens) > 1:
        last = tokens[-1].lower()
        industry = back.get(last) or sorted_back.get("".join(sorted(last)))
        tokens = tokens[:-1] if industry else tokens
    initials = "".join(t[0] for t in tokens) if len(tokens) > 2 else tokens[0] if len(tokens) == 1 and tokens[0].isupper() and len(tokens[0]) > 2 else None
    return None, [], "".join(tokens).lower(), place, industry, initials and initials.lower()


def missing_one(letters: str) -> list[str]:
    """The text and every text of one letter less: two texts of one typing error between them share one."""
    return sorted({letters} | {letters[:i] + letters[i + 1 :] for i in range(len(letters))})


def profiles(names: DataFrame, places: dict[str, str]) -> DataFrame:
    """(name, han, letters, folded, shorter, n, place, industry, initials, typed, begun) of each distinct name."""
    sounds = readings(names.sparkSession)
    order = lambda x: "".join(sorted(x))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b["name"]:
                han, syllables, letters, place, industry, initials = profile(name, places, sounds)
                folded = order("".join(re.sub("ng$", "n", x) for x in syllables)) if han else None
                n = len(syllables)
                shorter = [order("".join(syllables[:i] + syllables[i + 1 :])) for i in range(n)] if n > 3 else []
                typed = missing_one(letters) if len(letters) >= TYPED else []
                begun = han[:SHORTENED] if han and n > SHORTENED else None
                rows.append((name, han, order(letters) or None, folded, shorter, n, place, industry, initials, typed, begun))
            yield pd.DataFrame(rows, columns=["name", "han", "letters", "folded", "shorter", "n", "place", "industry", "initials", "typed", "begun"])

    schema = "name string, han string, letters string, folded string, shorter array<string>, n int, place string, industry string, initials string, typed array<string>, begun string"
    return names.where("name IS NOT NULL AND trim(name) <> ''").select("name").distinct().mapInPandas(run, schema)


def _keys(p: DataFrame) -> DataFrame:
    """The blocking keys of each profile: (cluster, place, industry, spellings, key, part), where part tells a
    core that lacks a syllable (1) from a whole one (0)."""
    key = lambda kind, *cols: F.when(
        F.expr(" AND ".join(f"{c} IS NOT NULL" for c in cols)), F.struct(F.concat_ws("|", F.lit(kind), *cols).alias("key"), F.lit(0).alias("part"))
    )
    both = "place IS NOT NULL AND industry IS NOT NULL"
    lack = F.when(F.expr(f"n >= 3 AND {both}"), F.struct(F.concat_ws("|", F.lit("D"), "letters", "industry", "place").alias("key"), F.lit(1).alias("part")))
    have = F.transform("shorter", lambda x: F.struct(F.concat_ws("|", F.lit("D"), x, F.col("industry"), F.col("place")).alias("key"), F.lit(0).alias("part")))
    keys = F.array(
        key("A", "letters", "industry", "place"), key("F", "folded", "industry", "place"), key("H", "han", "industry"), key("S", "han"),
        key("B", "letters", "industry"), key("E", "letters", "place"), key("C", "letters"),
        key("G", "folded", "industry"), key("K", "folded"), lack,
    )
    field = F.coalesce("industry", F.lit(""))
    typed = F.transform("typed", lambda x: F.struct(F.concat_ws("|", F.lit("T"), x, field).alias("key"), F.lit(0).alias("part")))
    loose = F.array(key("I", "initials"), key("P", "begun", "place"))
    every = F.concat(F.array_compact(keys), typed, F.array_compact(loose), F.when(F.expr(both), have).otherwise(F.array().cast("array<struct<key:string,part:int>>")))
    return p.select("cluster", "place", "industry", "spellings", F.inline(every))


def resolve(names: DataFrame, places: dict[str, str], rounds: int = 60) -> DataFrame:
    """(name, cluster): the organisation of each distinct name, named by its first spelling. Every round but the last
    merges something; that ``rounds`` do not suffice is an error, never a partial result."""
    p = materialise(profiles(names, places).withColumn("cluster", F.col("name")), "profiles")
    for _ in range(rounds):
        # A merged profile states what any of its spellings states, if they agree, and has all their keys.
        one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(f"all_{c}")
        joint = p.groupBy("cluster").agg(one("place"), one("industry"), F.count("*").alias("spellings"))
        rich = p.join(joint, "cluster").withColumns({"place": F.coalesce("place", "all_place"), "industry": F.coalesce("industry", "all_industry")})
        keys = _keys(rich).distinct()
        group = keys.groupBy("key").agg(
            F.min("cluster").alias("to"), F.count_distinct("cluster").alias("size"), F.count_distinct("place").alias("places"),
            F.count_distinct("industry").alias("industries"), F.count_distinct(F.when(F.col("part") == 0, F.col("cluster"))).alias("wholes"),
            F.max("part").alias("parts"), F.min("spellings").alias("fewest"),
        )
        kind = F.substring("key", 1, 2)
        lacking = (kind != "D|") | ((F.col("wholes") == 1) & (F.col("parts") == 1))
        loose = ~kind.isin("T|", "I|", "P|") | ((F.col("size") == 2) & (F.col("fewest") == 1))
        good = group.where((F.col("size") > 1) & (F.col("places") <= 1) & (F.col("industries") <= 1) & lacking & loose)
        moves = keys.join(good.select("key", "to"), "key").groupBy("cluster").agg(F.min("to").alias("to")).where("to < cluster")
        if moves.isEmpty():
            return p.select("name", "cluster")
        moved = p.join(moves, "cluster", "left").withColumn("cluster", F.coalesce("to", "cluster")).select(p.columns)
        nxt = materialise(moved, "profiles")
        discard(p)
        p = nxt
    raise RuntimeError(f"names not settled in {rounds} rounds")


def pairs(resolved: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different names of one organisation, by UTF-8 order."""
    a = resolved.select("cluster", F.col("name").alias("name_a"))
    b = resolved.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
