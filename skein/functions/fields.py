"""Normal forms of single fields: requirements, pay, titles, addresses, identifiers, times. All but ``inline`` and
``readable`` run in the JVM. Nulls and blanks give null unless a function says otherwise."""

from __future__ import annotations

import html
import html.entities
import html.parser
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.text import narrow, strip

LEVELS = ["博士", "硕士", "本科", "大专", "高中", "中专"]
# Codes of levels of education.
EDUCATION_CODES = {"博士": "10", "硕士": "14", "本科": "20", "大专": "30", "高中": "60", "中专": "40", "不限": "00"}


@F.pandas_udf(StringType())
def inline(values: pd.Series) -> pd.Series:
    """One line of text: entities resolved, compatibility forms unified, dashes as hyphens, single spaces."""
    dashes = str.maketrans("～—–", "---")
    return values.map(lambda v: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(v)).translate(dashes)).strip(), na_action="ignore")


# Elements that begin a new line, and elements within one.
BLOCKS = frozenset("address article aside blockquote dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
INLINES = frozenset("a abbr b bdi bdo cite code em font i img kbd mark q s small span strong sub sup u".split())


#: Stands for a line end between blocks; several in a row are one.
_END = "\0"


class _Page(html.parser.HTMLParser):
    """Text in slots. An opening tag stands in its slot as written, and is taken out when its partner comes."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.slots: list[str] = []
        self.waiting: dict[str, list[tuple[int, str]]] = {}

    def handle_startendtag(self, tag, attrs):
        known = tag in BLOCKS or tag in INLINES or tag == "br"
        self.slots.append((_END if tag not in INLINES else "") if known else self.get_starttag_text())

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "img"):
            self.handle_startendtag(tag, attrs)
            return
        if tag in BLOCKS or tag in INLINES:
            self.waiting.setdefault(tag, []).append((len(self.slots), dict(attrs).get("href") or ""))
        self.slots.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if not self.waiting.get(tag):
            self.slots.append(f"</{tag}>")
            return
        at, link = self.waiting[tag].pop()
        edge = _END if tag in BLOCKS else ""
        self.slots[at] = edge
        if tag == "a" and re.match(r"(?i)https?://[^/?#\s]", link) and link.isprintable():
            self.slots.append(f" [{link}]")
        self.slots.append(edge)

    def handle_data(self, data):
        self.slots.append(data)

    def handle_entityref(self, name):
        self.slots.append(html.unescape(f"&{name};") if f"{name};" in html.entities.html5 else f"&{name}")

    def handle_charref(self, name):
        self.slots.append(html.unescape(f"&#{name};"))


def page_text(page: str) -> str:
    """Readable text of markup. Known elements that are opened and closed vanish, block ones as line ends; what is
    unknown or without its partner stays as written; a link's http(s) address follows its text in brackets."""
    reader = _Page()
    reader.feed(page.replace(_END, ""))
    reader.close()
    text = re.sub("\0+", "\n", "".join(reader.slots))
    lines = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"\s+", " ", x).strip() for x in lines)).strip()


@F.pandas_udf(StringType())
def readable(pages: pd.Series) -> pd.Series:
    return pages.map(page_text, na_action="ignore")


def plain(c: Column) -> Column:
    """Narrow, with single spaces and hyphens for dashes; blank becomes null."""
    s = F.translate(narrow(c), "～~—–", "----")
    return F.nullif(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def education(c: Column) -> Column:
    s = plain(c)
    level = F.lit(None).cast("string")
    for name in reversed(LEVELS):
        level = F.when(F.contains(s, F.lit(name)), name).otherwise(level)
    more = F.when(F.contains(s, F.lit("以上")), "及以上").otherwise("")
    return F.when(level.isNotNull(), F.concat(level, more)).when(s.isin("不限", "无要求", "学历不限"), "不限").otherwise(s)


def education_code(c: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in EDUCATION_CODES.items() for x in kv])
    return codes[F.regexp_replace(education(c), "及以上$", "")]


def experience(c: Column) -> Column:
    s = plain(c)
    compact = F.regexp_replace(s, r"\s+", "")
    years = r"^(\d+)-?(\d+)?年(?:工作)?(?:经验)?$"
    lo, hi = F.regexp_extract(compact, years, 1), F.regexp_extract(compact, years, 2)
    span = F.when(hi != "", F.concat(lo, F.lit("-"), hi, F.lit("年"))).otherwise(F.concat(lo, F.lit("年")))
    return F.when(s.isin("不限", "无要求", "经验不限"), "不限").when(s.rlike("应届|无经验"), "无经验").when(compact.rlike(years), span).otherwise(s)


def pay_text(c: Column) -> Column:
    return F.replace(F.regexp_replace(plain(c), r"[¥￥\s]+", ""), F.lit("k"), F.lit("K"))


def region(c: Column) -> Column:
    return F.regexp_replace(plain(c), r"\s*([·,/])\s*", "$1")


# What a field holds when something else has run into it.
_SALARY = r"\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?\s*(?:元|[kK万])"
_WANTED = "岗位要求|职位要求|任职要求|招聘"


def foreign(c: Column, field: str) -> Column:
    """Why a field's value belongs elsewhere: multiline_text, too_long, requirement_text, salary_pattern, education_pattern,
    experience_pattern; null if it does not."""
    s = plain(c)
    why = F.when(c.rlike(r"[\r\n]"), "multiline_text").when(F.length(s) > 80, "too_long").when(s.rlike(_WANTED), "requirement_text")
    if field != "salary":
        why = why.when(s.rlike(_SALARY), "salary_pattern")
    if field != "education":
        why = why.when(s.rlike("本科|硕士|博士|大专|学历"), "education_pattern")
    if field != "experience":
        why = why.when(s.rlike(r"\d+\s*年(?:以上)?(?:工作)?经验|经验不限"), "experience_pattern")
    return why


def title(c: Column) -> Column:
    """Without bracketed remarks, a short prefix before a dash, and a word of seniority in front."""
    s = F.regexp_replace(F.regexp_replace(c, "[（(].*?[）)]", ""), "^[^-—]{1,10}[-—]", "")
    return strip(F.regexp_replace(s, "^(?:初级|中级|高级资深|高级|资深|专家)", ""))


def wording(c: Column) -> Column:
    """Lower-case letters and digits without 和, 及 and 与: equal for texts of equal wording."""
    return F.translate(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), "和及与", "")


def squeezed_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def record_id(source: Column, identity: Column) -> Column:
    """At most 47 characters of the source and 32 hexadecimal digits of both."""
    return F.concat(F.substring(source, 1, 47), F.lit("-"), F.substring(F.sha2(F.concat(source, F.lit("\0"), identity), 256), 1, 32))


def key_words(c: Column) -> Column:
    """The words of a key in camel case, with acronyms, underscores or hyphens, in lower case."""
    s = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(s), "[^a-z0-9一-鿿]+"), lambda w: w != "")


def url(c: Column) -> Column:
    """Lower-case scheme and host without user and default port, path or /, query sorted by name and value, no fragment;
    null for what is no http(s) address with a host."""
    whole = r"^(?i:(https?))://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
    g = lambda i: F.regexp_extract(c, whole, i)
    scheme, port = F.lower(g(1)), g(3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    parts = F.array_sort(F.transform(F.filter(F.split(g(5), "&"), lambda p: p != ""), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    query = F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("%20"), F.lit("+"))), "&")
    path = F.when(g(4) == "", "/").otherwise(g(4))
    full = F.concat(scheme, F.lit("://"), F.lower(g(2)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(c.rlike(whole), full)


def in_scope(address: Column, origin: str, prefixes: list[str]) -> Column:
    """Whether a canonical address is of the origin and under one of the path prefixes, in no layer of percent-encoding
    leaving it by dot segments."""
    plain_ = address
    for _ in range(3):
        plain_ = F.coalesce(F.try_url_decode(plain_), plain_)
    rest = F.substring(plain_, len(origin) + 1, 1 << 20)
    path = F.regexp_extract(rest, "^([^?#]*)", 1)
    under = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        under = under | (path == p) | path.startswith(p + "/")
    return plain_.startswith(origin) & under & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)") & ~path.rlike(r"\\")


def clamp(c: Column) -> Column:
    """A number within 0..1; what is none is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def without_offset(c: Column) -> Column:
    """The wall time of an ISO text, its offset dropped and not converted."""
    return F.try_to_timestamp(F.replace(F.regexp_replace(c, r"(?:Z|[+-]\d{2}:?\d{2})$", ""), F.lit("T"), F.lit(" ")))


def excerpt_at(text: Column, terms: list[str], size: int = 800) -> Column:
    """The 1-based start of the window of ``size`` characters of a text that holds most: windows begin a third of their size before the
    first place of a term, count the lengths of the terms they hold, and the earliest wins a tie."""
    low = F.lower(text)
    room = F.length(text) - size
    each = F.array(*[F.instr(low, t) for t in terms]) if terms else F.array().cast("array<int>")
    starts = F.transform(F.filter(each, lambda p: p > 0), lambda p: F.greatest(F.lit(0), F.least(p - 1 - size // 3, room)))
    starts = F.array_distinct(F.when(F.size(starts) == 0, F.array(F.lit(0))).otherwise(starts))

    def worth(at: Column) -> Column:
        window = F.substring(low, at + 1, F.lit(size))
        total = F.lit(0)
        for t in terms:
            total = total + F.when(F.contains(window, F.lit(t)), len(t)).otherwise(0)
        return total

    best = F.array_max(F.transform(starts, lambda at: F.struct(worth(at).alias("worth"), (-at).alias("at"))))
    return F.when(room <= 0, F.lit(1)).otherwise(1 - best["at"])


NEGATIONS = "不使用|无需|不涉及|仅了解|非核心|不负责|未使用|不要求|不采用|没有"


def named(text: Column, term: str, negations: bool = True) -> Column:
    """Whether a text (narrow, lower case) names a term as a word of its own, anywhere but after a negation in the same clause."""
    t = term.lower()
    lead = "(?<![a-z0-9])" if re.match("[a-z0-9]", t) else ""
    trail = "(?![a-z0-9])" if re.search("[a-z0-9]$", t) else ""
    # A look-behind of bounded length holds the negation and the signs that may join it to the term.
    no = rf"(?<!(?:{NEGATIONS})[\s、/和与及的]{{0,12}})" if negations else ""
    # Looking ahead first, so that what stands before is looked at only where the term begins.
    word = re.escape(t)
    return text.rlike(f"(?={word}){no}{lead}{word}{trail}")


def fenced_json(c: Column) -> Column:
    """The JSON object in an answer: what is fenced, else from the first { to the last }; null if that does not parse."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(inner != "", inner).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def cited(c: Column) -> Column:
    """The distinct citation marks of an answer, such as K1."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[K(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("K"), n)))


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quotation stands in a text, white space and case aside; a blank one does not."""
    return F.contains(squeezed_key(text), squeezed_key(quote)) & (squeezed_key(quote) != "")


def hidden_json(page: Column, name: str) -> Column:
    """The JSON that a page keeps in the hidden field of a name, its entities resolved; null if there is none, or it does not parse."""
    tag = F.regexp_extract(page, rf"""(?is)<input\b(?=[^>]*\btype\s*=\s*["']?hidden)(?=[^>]*\b(?:name|id)\s*=\s*["']?{re.escape(name)}["'\s>])[^>]*>""", 0)
    value = F.coalesce(F.nullif(F.regexp_extract(tag, r"""(?is)\bvalue\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.regexp_extract(tag, r"""(?is)\bvalue\s*=\s*'([^']*)'""", 1))
    for entity, sign in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return F.when((value != "") & F.try_parse_json(value).isNotNull(), value)
