"""Résumés, families, allocation and matching."""

from pyspark.sql import functions as F

from skein.operators import matching, resume
from skein.operators.allocation import Need, allocate
from skein.operators.families import Family, classify

CV = """张三
个人简介：5年后端开发经验，精通Java
专业技能
- 熟悉MySQL，不熟悉Kafka；熟练使用Docker
工作经历
2021.03 - 至今
甲乙科技有限公司 | 高级后端工程师
负责订单系统建设，使用Spring Boot
2019年7月至2021年5月 丙丁集团 Java开发工程师
维护支付服务，使用Redis
项目经历
订单平台
2022.01-2022.12
项目角色：负责人
行业场景：电商
使用Kubernetes部署
将平均延迟降低40%
教育经历
某大学 本科 2015-2019
"""


def test_resume():
    r = resume.read(CV, (2023, 6))
    assert r["headings"] == ["basic", "skills", "work", "projects", "education"] and r["warnings"] == []
    a, b = r["work"]
    assert (a["company"], a["role"], a["start"], a["end"], a["months"]) == ("甲乙科技有限公司", "高级后端工程师", "2021-03", "2023-06", 28)
    assert (b["company"], b["role"], b["start"], b["end"]) == ("丙丁集团", "Java开发工程师", "2019-07", "2021-05")
    assert r["months"] == 48  # the months that overlap count once
    p = r["projects"][0]
    assert (p["name"], p["role"], p["scenario"], p["results"]) == ("订单平台", "负责人", "电商", ["将平均延迟降低40%"])
    skills = {s["name"]: s for s in r["skills"]}
    assert "Kafka" not in skills and skills["Java"]["proficiency"] == "expert" and skills["Docker"]["proficiency"] == "advanced"
    assert skills["Kubernetes"]["sources"] == ["project"] and skills["Kubernetes"]["last_used"] == "2022-12" and skills["MySQL"]["strength"] == 0.78
    assert r["degrees"] == ["本科"] and set(r["recent"]) >= {"Spring Boot", "Kubernetes"} and "MySQL" not in r["recent"]


def test_resumes_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 200_000), (4, "2020.13 - 2021.01\n有3年开发工作经验"), (5, CV)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in resume.parse(df, "doc_id", "text", (2023, 6)).collect()}
    assert set(out) == {1, 3, 4, 5} and out[1].warnings == [] and out[3].warnings == ["no_section_headings"] and out[4].months == 36 and out[5].months == 48
    assert resume.parse(df.limit(0), "doc_id", "text", (2023, 6)).count() == 0


def test_families(spark):
    fam = [Family("BE", ["后端", "java工程师"], ["spring", "redis", "mysql"], ["前端"]), Family("DATA", ["数据工程师"], ["spark", "flink", "etl"])]
    rows = [(1, "后端开发", "熟悉spring与redis"), (2, "后端开发", "无需redis，无需spring"), (3, "数据工程师", "spark与etl，也会redis"), (4, "工程师", "spark、flink、etl"), (5, "后端 前端", "spring"), (6, None, None), (7, "后端/数据工程师", "spring spark")]
    got = {r.i: (r.status, r.family, r.confidence) for r in classify(spark.createDataFrame(rows, "i int, t string, x string"), "i", "t", "x", fam).collect()}
    assert got[1] == ("auto", "BE", 0.98) and got[2][0] == "review" and got[3] == ("auto", "DATA", 0.98) and got[4] == ("auto", "DATA", 0.94)
    assert got[5][0] == "review" and got[6] == ("review", None, 0.0) and got[7][0] == "review"


def test_allocation():
    picks = allocate([Need("a", 3), Need("b", 1)], {"x": 8, "y": 0}, {"x": 5, "y": 5, "z": 1}, 10, 0.5)
    assert [f for f, _ in picks] == ["a", "a", "a", "b"] and all(s != "x" for _, s in picks)
    assert picks.count(("a", "z")) + picks.count(("b", "z")) <= 1
    assert allocate([], {}, {"x": 1}, 3, 0.5) == [] and allocate([Need("a", 2)], {}, {}, 3, 0.5) == []


def test_caps_and_rest(spark):
    df = spark.createDataFrame([([3000, 1500, 1500, 1500, 1000, 500, 1000], 7900), ([100, 200, 0, 0, 0, 0, 0], 7900), ([3000, 3000, 1, 0, 0, 0, 0], 5900), ([5, 5, 0, 0, 0, 0, 0], 0)], "s array<bigint>, cap bigint")
    out = [r.x for r in df.select(matching.capped(F.col("s"), F.col("cap")).alias("x")).collect()]
    assert sum(out[0]) == 7900 and out[1] == [100, 200, 0, 0, 0, 0, 0] and sum(out[2]) == 5900 and sum(out[3]) == 0


def test_matching_of_extremes(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    pairs = t([(1, "p"), (2, "p"), (1, "none"), (3, "p")], "cand int, profile string")
    cands = t([(1, 10), (2, 0), (3, 5)], "cand int, years int")
    skills = t([(1, "A", 3, True, False, True, 100), (1, "A", 1, False, True, False, 90), (1, "B", 2, False, True, False, 100), (3, "A2", 3, True, False, False, 60)], "cand int, skill string, rank int, project boolean, work boolean, achieved boolean, month int")
    profs = t([("p", 5, 0.9, True), ("none", 0, 0.9, True)], "profile string, years int, sure double, ready boolean")
    targets = t([("p", "A", True, 3, 0.9), ("p", "B", True, 2, 0.4), ("p", "C", False, 2, 0.3)], "profile string, skill string, required boolean, rank int, prevalence double")
    duties, done = t([("p", "d")], "profile string, item string"), t([(1, "d"), (1, "d")], "cand int, item string")
    related = t([("A2", "A"), ("A", "A2")], "have string, want string")
    got = {(r.cand, r.profile): r for r in matching.score(pairs, cands, skills, profs, targets, duties, done, related, 100).collect()}
    full = got[1, "p"]
    assert (full.required, full.proficiency, full.experience, full.evidence, full.recency, full.preferred, full.duties) == (3000, 1500, 1500, 1350, 1000, 0, 1000)
    assert full.total == 9350 and full.band == "high" and full.confidence == "high"
    assert got[1, "none"].total == 0 and got[2, "p"].total == 0 and got[2, "p"].confidence == "low"
    near = got[3, "p"]
    assert near.required == 600 and near.total <= 5900 and near.exact == 0


def test_answers(spark):
    from skein.operators import answers

    ev = spark.createDataFrame([("K2", "乙", "y  y"), ("K1", "甲", "x" * 300)], "cite string, title string, text string")
    assert answers.answer("q", ev, lambda p: "是[K1]。" if "[K2] 乙" in p else "").mode == "model"
    for bad in (lambda p: "无", lambda p: "[K3]", lambda p: 1 / 0, None):
        a = answers.answer("q", ev, bad)
        assert a.mode == "extract" and a.valid and a.text.splitlines() == ["- [K1] 甲：" + "x" * 180, "- [K2] 乙：y y"]

    class Lengths:
        def embed_documents(self, texts):
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i bigint, t string")
    assert {r.i: r.vector for r in answers.embed(df, "i", "t", Lengths).collect()} == {1: [2.0], 3: [0.0]}
    skills = spark.createDataFrame([(1, "A", 1, ["skill"])], "key int, skill string, rank int, sources array<string>")
    found = spark.createDataFrame([(1, "A", 3, "熟悉 a"), (1, "B", 2, "nowhere"), (1, "C", 1, "")], "key int, skill string, rank int, quote string")
    texts = spark.createDataFrame([(1, "他熟悉A。")], "key int, text string")
    assert [(r.skill, r["rank"], r.sources) for r in answers.enrich(skills, found, texts).collect()] == [("A", 3, ["model", "skill"])]


def test_engine_and_pipeline(spark, tmp_path):
    from skein.api import Engine
    from skein.plans import pipeline

    e = Engine(spark, "/root/testdata/sf0.001")
    assert "jobs" in e.tables() and "quality_gate" in e.queries() and e.sql("SELECT count(*) AS n FROM jobs").first().n == e.run("quality_gate").count()
    out = f"file://{tmp_path}/run"
    a = pipeline.run(spark, "/root/testdata/sf0.001", out, "2026-01-01", ["dup_master", "chunk_refresh"])
    assert a == pipeline.run(spark, "/root/testdata/sf0.001", out, "2026-01-02", ["dup_master", "chunk_refresh"])
    assert spark.read.parquet(f"{out}/runs").where("status = 'done'").count() == 4
