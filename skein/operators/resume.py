"""Résumés as records: sections, periods of work, projects, and skills with the evidence for them.

A résumé is read line by line, in order, which needs state; texts of a batch are read in one Arrow batch each. Null texts
give no row; an empty one gives empty lists; lines before any heading are basic information; long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.lexicon import ALIASES, RANKS, SKILLS

# Headings of sections, how far a mention in one is trusted, and words of levels, duties, results and roles.
SECTIONS = {
    "basic": "个人简介 个人信息 基本信息 自我评价 职业概述 简介 summary basic_information", "skills": "专业技能 核心技能 技能清单 技能 skills",
    "work": "工作经历 工作经验 职业经历 任职经历 work_experience employment", "projects": "项目经历 项目经验 项目 projects project_experience",
    "education": "教育经历 教育背景 学历 education", "certificates": "证书资质 资格证书 认证证书 证书 认证 certificates certifications",
}
STRENGTH = {"work": 0.96, "project": 0.93, "skill": 0.78, "basic": 0.72, "certificate": 0.70, "education": 0.65}
LEVELS = [("expert", "精通|专家|expert"), ("advanced", "熟练掌握|熟练使用|主导|架构|高级|advanced"), ("working", "掌握|熟悉|使用|开发|负责|建设|工程师|working")]
DENIED = r"不会|不熟悉|未掌握|未使用|没有使用|计划学习|准备学习|打算学习|将学习|正在学习|学习中|初学|自学|not\s+(?:familiar|proficient)|never\s+(?:used?|worked\s+with)|no\s+experience\s+(?:with|in)|unfamiliar\s+with|plan(?:ning)?\s+to\s+learn|currently\s+learning|learning"
CLAIMED = r"精通|熟练掌握|熟练使用|掌握|熟悉|使用|开发|负责|建设|主导|expert|proficient|familiar|used?|develop(?:ed|ing)?"
DUTY = "负责|参与|使用|开发|设计|建设|维护|实现|主导|优化"
BETTER = "提升|降低|减少|增长|节省|缩短|达到|提高"
ROLE = "工程师|开发|架构师|经理|负责人|顾问|实习生|技术专家"
DEGREES = ["博士", "硕士", "本科", "大专", "专科"]

_HEADING = {a.replace("_", " "): k for k, v in SECTIONS.items() for a in v.split()}
_TITLE = re.compile(rf"(?i)({'|'.join(sorted(map(re.escape, _HEADING), key=len, reverse=True))})\s*(?:[:：]\s*(.*))?")
_MARK = re.compile(r"\s*(?:#{1,6}\s+|[-*•·]\s*|\d{1,2}[、)）]\s*|\d{1,2}\.\s+)")
_MONTH = r"((?:19|20)\d{2})\s*(?:[.\-/]\s*|年\s*)(\d{1,2})(?:\s*月)?"
_PERIOD = re.compile(rf"(?i){_MONTH}\s*[-–—~到至]\s*(?:{_MONTH}|(至今|今|现在|present))")
_ORG = r"公司|集团|银行|研究院|研究所|中心|科技"
_SPELLING = {a: n for n, _, a in ALIASES} | {n.lower(): n for n in SKILLS}
_SKILL = re.compile("|".join(rf"(?<![a-z0-9_]){re.escape(a)}(?![a-z0-9_])" if a.isascii() else re.escape(a) for a in sorted(_SPELLING, key=len, reverse=True)))
_INTENT = re.compile(rf"(?i)({DENIED})|({CLAIMED})")
_CLAUSE = re.compile(r"[；;。！？!?]|但是|不过|然而|但")
_RESULT = re.compile(rf"(?i)\d+(?:\.\d+)?\s*(?:[%％倍万亿秒]|ms|毫秒|分钟|小时|人日|qps)")
_BARE_RESULT = re.compile(rf"(?:{BETTER})\s*[至到为约]?\s*\d{{1,9}}(?!\d)")
_NOISE = re.compile(r"(?<!\d)1[3-9]\d{9}(?!\d)|(?:19|20)\d{2}\s*[.\-/年]\s*\d{1,2}(?:\s*月)?")

SCHEMA = (
    "headings array<string>, work array<struct<company:string,role:string,start:string,end:string,months:int,duties:array<string>>>,"
    " projects array<struct<name:string,role:string,start:string,end:string,scenario:string,results:array<string>,duties:array<string>>>,"
    " skills array<struct<name:string,category:string,proficiency:string,strength:double,last_used:string,sources:array<string>>>,"
    " months int, degrees array<string>, recent array<string>, dated boolean, warnings array<string>"
)


def period(line: str, now: tuple[int, int]) -> tuple[int, int] | None:
    """(first, last) month of a line's period, as year * 12 + month - 1; None without one, or with an impossible one."""
    m = _PERIOD.search(line)
    if not m:
        return None
    end = now if m[5] else (int(m[3]), int(m[4]))
    if not (1 <= int(m[2]) <= 12 and 1 <= end[1] <= 12):
        return None
    span = int(m[1]) * 12 + int(m[2]) - 1, end[0] * 12 + end[1] - 1
    return span if span[0] <= span[1] else None


def month(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def header(line: str) -> tuple[str | None, str | None]:
    """(company, role) that a line names, by labels, by a bar or wide gap between them, or by how it ends."""
    s = _MARK.sub("", line, count=1).strip(" |｜,，-/")
    if not s or re.match(DUTY, s):
        return None, None
    label = {k: m[1].strip() for k, w in (("company", "公司|单位"), ("role", "职位|岗位|职务|角色")) if (m := re.search(rf"(?:{w})\s*[:：]\s*([^|｜,，]+)", s))}
    if label:
        return label.get("company"), label.get("role")
    m = re.fullmatch(rf"(.+?(?:{_ORG}))(?:\s*[|｜]\s*|\s+)(.+)", s)
    if m and re.search(ROLE, m[2]):
        return m[1].strip(), m[2].strip()
    return (None, s) if re.search(r"(?:工程师|架构师|经理|负责人|顾问|实习生|技术专家)$", s) else (None, None)


def achieved(line: str) -> bool:
    """A result with a number: a quantity beside a word of improvement, or a bare number after one."""
    return bool(_RESULT.search(line) and re.search(f"{BETTER}|优化", line)) or bool(_BARE_RESULT.search(_NOISE.sub("", line)))


def skills_in(line: str) -> set[str]:
    """The skills a line names and does not deny: of the intents before it in its clause the last holds."""
    low = line.lower()
    out = set()
    for m in _SKILL.finditer(low):
        clause = _CLAUSE.split(low[: m.start()])[-1]
        last = None
        for x in _INTENT.finditer(clause):
            last = x
        if last is None or last[1] is None:
            out.add(_SPELLING[m[0]])
    return out


def jobs(lines: list[str], now: tuple[int, int]) -> list[dict]:
    """Periods of work: one begins at a period, or at a header that no bare period stands right before."""
    blocks: list[list[str]] = []
    for line in lines:
        dated, named = period(line, now) is not None, header(_PERIOD.sub("", line)) != (None, None)
        after_date = bool(blocks) and len(blocks[-1]) == 1 and period(blocks[-1][0], now) is not None
        if not blocks or dated or (named and not after_date):
            blocks.append([])
        blocks[-1].append(line)
    out = []
    for block in blocks:
        span = period(block[0], now)
        own = header(_PERIOD.sub("", block[0], count=1))
        rest = block[1:]
        if own == (None, None) and span and rest:
            own = header(rest[0])
            rest = rest[1:] if own != (None, None) else rest
        if own == (None, None) and not span:
            rest = block
        out.append({"company": own[0], "role": own[1], "span": span, "duties": rest, "lines": block})
    return out


def undertakings(lines: list[str], now: tuple[int, int]) -> list[dict]:
    """Projects: one begins at a named one, or at a title whose next line has a period, after one that has a period."""

    def title(line: str) -> bool:
        s = _MARK.sub("", line, count=1).strip()
        return len(s) <= 80 and not re.search(DUTY, s) and not achieved(s) and not re.match(r"(?:行业场景|应用场景|项目角色|角色)\s*[:：]", s)

    blocks: list[list[str]] = []
    dated = False
    for i, line in enumerate(lines):
        fresh = re.match(r"(?:项目名称|项目名)\s*[:：]", _MARK.sub("", line, count=1)) is not None
        ahead = i + 1 < len(lines) and period(lines[i + 1], now) is not None
        if not blocks or fresh or (dated and ahead and title(line)):
            blocks.append([])
            dated = False
        blocks[-1].append(line)
        dated = dated or period(line, now) is not None
    out = []
    for block in blocks:
        spans = [p for p in (period(x, now) for x in block) if p]
        when = [x for x in block if period(x, now)]
        head = _MARK.sub("", _PERIOD.sub("", when[0], count=1), count=1).strip(" |｜,，-/") if when else ""
        head = "" if re.fullmatch(r"(?:项目周期|项目日期|周期|日期|时间)\s*[:：]?", head) else head
        first = block[0] if block[0] not in when and title(block[0]) else ""
        parts = [x.strip() for x in re.split(r"[|｜]", head or _MARK.sub("", first, count=1)) if x.strip()]
        label = {k: m[1].strip() for k, w in (("role", "项目角色|角色"), ("scenario", "行业场景|应用场景")) for x in block if (m := re.match(rf"(?:{w})\s*[:：]\s*(.+)", _MARK.sub("", x, count=1)))}
        name = re.sub(r"^(?:项目名称|项目名|项目)\s*[:：]\s*", "", parts[0]).strip() if parts else None
        results = [x for x in block if achieved(x)]
        duties = [x for x in block if x not in results and x not in when and x != first and not re.match(r"(?:行业场景|应用场景|项目角色|角色)\s*[:：]", _MARK.sub("", x, count=1))]
        span = (min(a for a, _ in spans), max(b for _, b in spans)) if spans else None
        out.append({"name": name or None, "role": label.get("role") or (parts[1] if len(parts) > 1 else None), "scenario": label.get("scenario"), "span": span, "results": results, "duties": duties, "lines": block})
    return out


def read(text: str, now: tuple[int, int]) -> dict:
    """One résumé as a SCHEMA row; ``now`` is the (year, month) that "to date" means."""
    held: dict[str, list[str]] = {k: [] for k in SECTIONS}
    at, seen = "basic", []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        m = _TITLE.fullmatch(_MARK.sub("", line, count=1).strip())
        if m:
            at = _HEADING[m[1].lower()]
            seen.append(at)
            line = (m[2] or "").strip()
        if line:
            held[at].append(line)
    work, projects = jobs(held["work"], now), undertakings(held["projects"], now)
    last = lambda e: month(e["span"][1]) if e["span"] else None
    told = [(x, source, None) for k, source in (("basic", "basic"), ("skills", "skill"), ("education", "education"), ("certificates", "certificate")) for x in held[k]]
    told += [(x, source, last(e)) for es, source in ((work, "work"), (projects, "project")) for e in es for x in e["lines"]]
    known: dict[str, dict] = {}
    for line, source, used in told:
        level = next((n for n, words in LEVELS if re.search(words, line.lower())), "aware")
        for name in skills_in(line):
            r = known.setdefault(name, {"name": name, "category": SKILLS[name][0], "proficiency": "aware", "strength": 0.0, "last_used": None, "sources": set()})
            r["proficiency"] = max(r["proficiency"], level, key=RANKS.get)
            r["strength"] = max(r["strength"], STRENGTH[source])
            r["last_used"] = max(filter(None, (r["last_used"], used)), default=None)
            r["sources"].add(source)
    months = {i for e in work if e["span"] for i in range(e["span"][0], e["span"][1] + 1)}
    spoken = re.findall(r"(\d+(?:\.\d+)?)\s*年(?=[^，。；;\n]{0,20}(?:工作|开发|从业|职业|行业|实战)经验)", "\n".join(held["basic"] + held["skills"] + held["work"]))
    dated = any(e["span"] for e in work + projects)
    cutoff = f"{now[0] - 2:04d}-{now[1]:02d}"
    skills = sorted(known.values(), key=lambda r: r["name"].lower())
    recent = [r["name"] for r in skills if not dated or (r["last_used"] or "") >= cutoff]
    span = lambda e: {"start": month(e["span"][0]) if e["span"] else None, "end": last(e)}
    return {
        "headings": list(dict.fromkeys(seen)),
        "work": [{"company": e["company"], "role": e["role"], **span(e), "months": e["span"][1] - e["span"][0] + 1 if e["span"] else None, "duties": e["duties"]} for e in work],
        "projects": [{"name": e["name"], "role": e["role"], **span(e), "scenario": e["scenario"], "results": e["results"], "duties": e["duties"]} for e in projects],
        "skills": [r | {"sources": sorted(r["sources"])} for r in skills], "months": len(months) if months else round(12 * max(map(float, spoken), default=0.0)),
        "degrees": [d for d in DEGREES if d in "\n".join(held["education"])], "recent": recent, "dated": dated, "warnings": [] if seen or not text.strip() else ["no_section_headings"],
    }


def parse(df: DataFrame, key: str, text: str, now: tuple[int, int]) -> DataFrame:
    """(key, SCHEMA columns) of every row with a text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{key: k} | read(t, now) for k, t in zip(b["key"], b["text"], strict=True)], columns=[key, *names])

    names = ["headings", "work", "projects", "skills", "months", "degrees", "recent", "dated", "warnings"]
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, {SCHEMA}")
