"""Fixed values of the domain: skills with their categories and spellings, ranks and relations of skills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical skill, its category, and its spellings in lower case.
SKILLS = {
    "Java": ("language", ["java"]), "Python": ("language", ["python"]), "Go": ("language", ["golang", "go语言"]),
    "JavaScript": ("language", ["javascript", "js开发"]), "TypeScript": ("language", ["typescript"]),
    "Spring Boot": ("framework", ["spring boot", "springboot"]), "Spring Cloud": ("framework", ["spring cloud", "springcloud"]),
    "FastAPI": ("framework", ["fastapi"]), "Django": ("framework", ["django"]), "Vue": ("framework", ["vue.js", "vuejs", "vue"]),
    "React": ("framework", ["react.js", "reactjs", "react"]), "MySQL": ("database", ["mysql"]), "PostgreSQL": ("database", ["postgresql", "postgres"]),
    "Redis": ("database", ["redis"]), "MongoDB": ("database", ["mongodb"]), "Neo4j": ("database", ["neo4j"]),
    "Docker": ("cloud_native", ["docker", "容器化"]), "Kubernetes": ("cloud_native", ["kubernetes", "k8s"]), "Linux": ("platform", ["linux"]),
    "Git": ("tool", ["git版本", "git"]), "CI/CD": ("devops", ["ci/cd", "持续集成", "持续交付"]), "Jenkins": ("devops", ["jenkins"]),
    "Prometheus": ("observability", ["prometheus"]), "Grafana": ("observability", ["grafana"]), "大语言模型": ("ai", ["大语言模型", "大模型", "llm"]),
    "RAG": ("ai", ["检索增强生成", "rag"]), "LangChain": ("ai_framework", ["langchain"]), "AI Agent": ("ai", ["ai agent", "智能体", "agent开发"]),
    "MCP": ("ai", ["model context protocol", "mcp协议", "mcp"]), "向量数据库": ("ai_infra", ["向量数据库", "vector database"]),
    "Embedding": ("ai", ["embedding", "向量嵌入"]), "PyTorch": ("ml_framework", ["pytorch"]), "TensorFlow": ("ml_framework", ["tensorflow"]),
    "多模态": ("ai", ["多模态", "vision language"]), "Hadoop": ("big_data", ["hadoop"]), "Spark": ("big_data", ["apache spark", "spark"]),
    "Flink": ("big_data", ["apache flink", "flink"]), "Kafka": ("big_data", ["kafka"]), "ETL": ("data", ["etl"]),
    "数据仓库": ("data", ["数据仓库", "data warehouse"]), "元数据管理": ("data_governance", ["元数据管理", "metadata management"]),
    "数据质量": ("data_governance", ["数据质量", "data quality"]), "MQTT": ("iot", ["mqtt"]), "物联网": ("iot", ["物联网", "iot"]),
    "嵌入式": ("embedded", ["嵌入式"]), "边缘计算": ("edge", ["边缘计算", "edge computing"]), "网络安全": ("security", ["网络安全", "攻防", "渗透测试"]),
    "数字孪生": ("intelligent_system", ["数字孪生", "digital twin"]), "ROS": ("robotics", ["robot operating system", "ros"]),
}
# Ranks of proficiency, skills that stand in for each other, and what a skill builds on.
RANKS = {"aware": 1, "working": 2, "advanced": 3, "expert": 4}
RELATED = [("MySQL", "PostgreSQL")]
PREREQUISITES = {"Docker": ["Linux"], "Kubernetes": ["Docker"]}
# Words that make a skill a preference, and words of a responsibility.
PREFERRED = ["优先", "加分", "preferred", "plus", "更佳"]
RESPONSIBLE = ["负责", "职责", "参与", "建设", "开发", "维护", "推进", "设计"]

ALIASES = [(name, category, alias) for name, (category, aliases) in SKILLS.items() for alias in aliases]


def canonical_skill(c: Column) -> Column:
    """struct(name, category): a known spelling's skill, else the trimmed value as it is, of category general."""
    known = {n.lower(): (n, k) for n, (k, _) in SKILLS.items()} | {a: (n, k) for n, k, a in ALIASES}
    names = F.create_map(*[F.lit(x) for a, (n, _) in known.items() for x in (a, n)])
    kinds = F.create_map(*[F.lit(x) for a, (_, k) in known.items() for x in (a, k)])
    key = F.lower(F.trim(c))
    return F.struct(F.coalesce(names[key], F.nullif(F.trim(c), F.lit(""))).alias("name"), F.coalesce(kinds[key], F.lit("general")).alias("category"))


def closure(skill: str) -> list[str]:
    """What a skill builds on, directly or not, foundations first."""
    out: list[str] = []
    todo = [(skill, iter(PREREQUISITES.get(skill, [])))]
    seen = {skill}
    while todo:
        name, rest = todo[-1]
        nxt = next((x for x in rest if x not in seen), None)
        if nxt is not None:
            seen.add(nxt)
            todo.append((nxt, iter(PREREQUISITES.get(nxt, []))))
            continue
        todo.pop()
        if name != skill:
            out.append(name)
    return out


def relation(have: str, want: str) -> str:
    """exact, related, prerequisite or none, of two canonical skills."""
    if have == want:
        return "exact"
    if (have, want) in RELATED or (want, have) in RELATED:
        return "related"
    return "prerequisite" if have in closure(want) else "none"


def mentions(text: Column, before: int = 18, after: int = 24) -> Column:
    """array<struct(name, category, alias, pos, evidence, requirement, confidence)>: each skill that a text names, by its
    earliest spelling, the longer one on a tie, with the text around it; empty for a null text.

    The text is lowered once, as the variable of a one-element transform, and each skill takes the least of its own spellings.
    """

    def first(low: Column, aliases: list[str]) -> Column:
        at = [F.instr(low, a) for a in aliases]
        return F.array_min(F.array_compact(F.array(*[F.when(p > 0, F.struct(p.alias("pos"), F.lit(-len(a)).alias("minus"), F.lit(a).alias("alias"))) for p, a in zip(at, aliases, strict=True)])))

    def of(d: Column) -> Column:
        hits = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("category"), first(d["low"], aliases).alias("m")) for n, (k, aliases) in SKILLS.items()])
        found = F.filter(hits, lambda x: x["m"].isNotNull())
        start = lambda x: F.greatest(F.lit(1), x["m"]["pos"] - before)
        around = lambda x: F.trim(F.substring(d["text"], start(x), x["m"]["pos"] - x["m"]["minus"] + after - start(x)), F.lit(" \t\n\r"))
        with_text = F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["category"].alias("category"), x["m"].alias("m"), around(x).alias("evidence")))
        return F.transform(with_text, lambda x: F.struct(
            x["name"].alias("name"), x["category"].alias("category"), x["m"]["alias"].alias("alias"), x["m"]["pos"].alias("pos"), x["evidence"].alias("evidence"),
            F.when(F.lower(x["evidence"]).rlike("|".join(PREFERRED)), "preferred").otherwise("required").alias("requirement"),
            F.when(x["m"]["alias"] == F.lower(x["name"]), 0.92).otherwise(0.86).alias("confidence"),
        ))

    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), of)[0]
