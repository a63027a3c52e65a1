"""Normal forms of fields and rules with golden cases."""

import pytest
from pyspark.sql import functions as F

from skein.functions import fields, lexicon
from skein.operators import profiles


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "before,after,req_b,req_a,ev_b,ev_a,want",
    [(0.0, 0.2, None, "required", 0, 4, "added"), (0.2, 0.0, "required", None, 4, 0, "removed"), (0.2, 0.35, "preferred", "preferred", 4, 7, "modified"), (0.2, 0.2, "preferred", "required", 4, 4, "modified"),
     (0.2, 0.2, "required", "preferred", 4, 2, "none"), (0.0, 0.2, None, "required", 0, 2, "none"), (0.2, 0.2, None, "required", 4, 4, "none")],
)
def test_change_kind(spark, before, after, req_b, req_a, ev_b, ev_a, want):
    df = spark.createDataFrame([(before, after, ev_b, ev_a, req_b, req_a)], "b double, a double, eb int, ea int, rb string, ra string")
    assert df.select(profiles.change_kind(df.b, df.a, df.eb, df.ea, df.rb, df.ra).alias("x")).first().x == want


def test_addresses(spark):
    cases = {
        "HTTPS://User@Www.X.Example:443/A?b=2&a=1&c#f": "https://www.x.example/A?a=1&b=2&c=", "http://x.example:8080": "http://x.example:8080/", "http://x.example:80/p": "http://x.example/p",
        "ftp://x.example/": None, "http:///p": None, "": None, None: None, "https://x.example?q=a%20b": "https://x.example/?q=a+b",
    }
    assert dict(zip(cases, run(spark, fields.url, list(cases)))) == cases
    scope = {"https://x.example/jobs/1": True, "https://x.example/jobs": True, "https://x.example/jobsearch": False, "https://y.example/jobs/1": False, "https://x.example/jobs/../a": False, "https://x.example/jobs/%252e%252e/a": False}
    assert dict(zip(scope, run(spark, lambda c: fields.in_scope(c, "https://x.example", ["/jobs/"]), list(scope)))) == scope


def test_pages(spark):
    cases = {
        "<p>甲&amp;乙</p><p>丙<br>丁</p>": "甲&乙\n丙\n丁", "C<T> &copy; <b>x</b> <b>y": "C<T> © x <b>y", '<a href="https://x.example/a">招聘</a><a href="javascript:x">no</a>': "招聘 [https://x.example/a]no",
        "1 < 2 & 3": "1 < 2 & 3", "": "", None: None, "<ul><li>一</li><li>二</li></ul>": "一\n二", "ＡＢ": "AB",
    }
    got = dict(zip(cases, run(spark, fields.readable, list(cases))))
    assert got == cases
    assert fields.page_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"


def test_inline(spark):
    assert run(spark, fields.inline, ["　Ａ&amp;Ｂ\n c—d ", None, ""]) == ["A&B c-d", None, ""]


def test_named_terms_and_negations(spark):
    texts = ["无需 kafka 经验", "无需docker，熟悉kafka", "kafkaesque", "不使用、kafka；但用 kafka 2", None, "", "未使用和及kafka", "x" * 100000 + " kafka"]
    assert run(spark, lambda c: fields.named(c, "kafka"), texts) == [False, True, False, True, None, False, False, True]
    assert run(spark, lambda c: fields.named(c, "kafka", negations=False), texts)[:4] == [True, True, False, True]


def test_answers(spark):
    assert run(spark, fields.fenced_json, ['x ```json\n{"a": 1}\n``` y', 'so {"a": {"b": 2}} end', "{broken", None, ""]) == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]
    assert run(spark, fields.cited, ["甲[K1]乙[K12][K1]", "[K]", None]) == [["K1", "K12"], [], None]
    df = spark.createDataFrame([("熟悉 Kafka", "要求：熟悉kafka 者", True), (" ", "x", False), ("甲", "乙", False)], "q string, t string, want boolean")
    assert all(r.x == r.want for r in df.select("want", fields.grounded(df.q, df.t).alias("x")).collect())


def test_skills(spark):
    rows = run(spark, lexicon.mentions, ["熟悉MySQL与Docker，有k8s经验者优先。", "", None])
    got = {(m["name"], m["alias"], m["requirement"], m["confidence"]) for m in rows[0]}
    assert ("MySQL", "mysql", "preferred", 0.92) in got
    assert ("Kubernetes", "k8s", "preferred", 0.86) in got and rows[1:] == [[], []]
    assert lexicon.closure("Kubernetes") == ["Linux", "Docker"] and lexicon.closure("Java") == []
    assert [lexicon.relation(*p) for p in [("Go", "Go"), ("MySQL", "PostgreSQL"), ("Linux", "Kubernetes"), ("Docker", "Linux")]] == ["exact", "related", "prerequisite", "none"]
    assert [tuple(x) for x in run(spark, lexicon.canonical_skill, [" K8S ", "golang", "Zig", "", None])] == [("Kubernetes", "cloud_native"), ("Go", "language"), ("Zig", "general"), (None, "general"), (None, "general")]


def test_key_words(spark):
    assert run(spark, fields.key_words, ["jobDescHTML", "HTTPCode_x-y", "岗位ID", "", None]) == [["job", "desc", "html"], ["http", "code", "x", "y"], ["岗位id"], [], None]


def test_excerpts(spark):
    text = "a" * 300 + "kafka" + "b" * 300 + "docker kafka" + "c" * 300
    at = run(spark, lambda c: fields.excerpt_at(c, ["kafka", "docker"], 100), [text, "short", "z" * 500, None])
    assert text[at[0] - 1 : at[0] + 99].count("kafka") == 1 and "docker" in text[at[0] - 1 : at[0] + 99] and at[1:3] == [1, 1]


def test_hidden_json(spark):
    pages = {
        '<input type="hidden" id="rows" value="[{&quot;a&quot;: &quot;x &amp; y&quot;}]">': '[{"a": "x & y"}]', "<form><INPUT name='rows' type=hidden value='{\"a\": 1}'/></form>": '{"a": 1}',
        '<input type="text" id="rows" value="{}">': None, '<input type="hidden" id="rows" value="{broken">': None, '<input type="hidden" id="rows2" value="{}">': None, "": None, None: None,
    }
    assert dict(zip(pages, run(spark, lambda c: fields.hidden_json(c, "rows"), list(pages)))) == pages
