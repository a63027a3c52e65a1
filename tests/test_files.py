"""File sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from skein.sources import files, sinks


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return f"file://{folder}/{name}"


def rows(df):
    return [(r.line_number, r.raw, r.error) for r in df.orderBy("line_number").collect()]


def test_json_lines_keep_bad_lines(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", '﻿{"a": 1}\n\n[1]\n{"a": 1} x\r\n{"b": null}\n')
    assert rows(files.json_lines(spark, p)) == [(1, '{"a": 1}', None), (3, "[1]", "invalid_json"), (4, '{"a": 1} x', "invalid_json"), (5, '{"b": null}', None)]
    with pytest.raises(ValueError, match="3: invalid_json"):
        files.strict(files.json_lines(spark, p))
    assert files.json_lines(spark, put(tmp_path, "e.jsonl", "")).count() == 0


def test_json_arrays_and_objects(spark, tmp_path):
    assert rows(files.json_items(spark, put(tmp_path, "a.json", '[{"a": 1}, 2, {"b": "x"}]'))) == [(1, '{"a":1}', None), (2, "2", "invalid_record"), (3, '{"b":"x"}', None)]
    assert rows(files.json_items(spark, put(tmp_path, "o.json", ' {"a": [1]} '))) == [(1, '{"a":[1]}', None)]
    for bad in ('[{"a": 1},]', '[{"a": 1}] x', '{"a": 1} {"b": 2}', "7"):
        assert [r[2] for r in rows(files.json_items(spark, put(tmp_path, "b.json", bad)))] == ["invalid_json"]
    assert files.json_items(spark, put(tmp_path, "n.json", "[]")).count() == 0


def test_csv(spark, tmp_path):
    got = rows(files.csv_rows(spark, put(tmp_path, "a.csv", '岗位ID,公司 名称\n1,甲\n2,"乙,\n丙"\n3\n')))
    assert [(n, e) for n, _, e in got] == [(2, None), (3, None), (4, "wrong_cell_count")]
    assert json.loads(got[1][1]) == {"岗位ID": "2", "公司 名称": "乙,\n丙"}


def test_bounds(spark, tmp_path):
    deep = "[" * 6 + "]" * 6
    p = put(tmp_path, "a.jsonl", '{"a": "' + "x" * 50 + '"}\n{"a": ' + deep + '}\n{"a": "[[[[[[[["}\n')
    got = [r[2] for r in rows(files.bounded(files.json_lines(spark, p), line_bytes=40, most=6))]
    assert got == ["line_too_long", "too_deep", None]
    assert {r[2] for r in rows(files.bounded(files.json_lines(spark, p), file_records=2))} == {"too_many_records"}
    assert {r[2] for r in rows(files.bounded(files.json_lines(spark, p), file_bytes=20))} == {"file_too_large"}


def test_exports_by_alias(spark, tmp_path):
    lines = [{"岗位 名称": " 甲 ", "Salary": "=1+1"}, {"job_name": "", "Title": "乙", "salary": "-5"}, {"JobName": "丙", "job_name": "丁"}, {"x": "1"}]
    p = put(tmp_path, "a.jsonl", "\n".join(json.dumps(x, ensure_ascii=False) for x in lines))
    aliases = {"title": ["job_name", "岗位名称", "title"], "pay": ["salary"]}
    got = [(r.title, r.pay, r.error) for r in files.exported(files.json_lines(spark, p), aliases).orderBy("line_number").collect()]
    assert got == [("甲", "=1+1", "formula_cell"), ("乙", "-5", None), (None, None, "duplicate_header"), (None, None, None)]
    assert [r.line_number for r in files.exported(files.json_lines(spark, p), aliases, 1, 2).orderBy("line_number").collect()] == [2, 3]


def test_unique_cases(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", '{"case_id": "a"}\n{"case_id": "b"}')
    assert files.unique(files.json_lines(spark, p), "case_id").count() == 2
    with pytest.raises(ValueError, match="repeated or missing: a"):
        files.unique(files.json_lines(spark, put(tmp_path, "b.jsonl", '{"case_id": "a"}\n{"case_id": "a"}')), "case_id")


def test_manifests_and_documents(spark, tmp_path):
    put(tmp_path / "d", "x.txt", "﻿甲")
    put(tmp_path / "d", "y.pdf", "?")
    m = spark.createDataFrame([(1, "inline", None), (2, None, "x.txt"), (3, "a", "x.txt"), (4, None, None), (5, None, "../x.txt"), (6, None, "z.txt")], "id int, inline string, path string")
    got = {r.id: (r.text and r.text.strip("﻿"), r.error) for r in files.pointed(spark, m, f"file://{tmp_path}/d").collect()}
    assert got == {1: ("inline", None), 2: ("甲", None), 3: (None, "two_texts"), 4: (None, "no_text"), 5: (None, "outside_folder"), 6: (None, "missing_file")}
    assert sorted((r.text, r.error) for r in files.documents(spark, f"file://{tmp_path}/d").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error")).collect()) == [("", "unknown_kind"), ("甲", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "staged", 1), ("a", "staged", 2), ("c", "review", 3)], "record_id string, destination string, n int")
    sinks.write_routed(df.coalesce(1), f"file://{tmp_path}/routed")
    assert {p.name for p in (tmp_path / "routed").iterdir() if p.is_dir()} == {"destination=staged", "destination=review"}
    staged = next((tmp_path / "routed" / "destination=staged").glob("*.json")).read_text().splitlines()
    assert [json.loads(x)["record_id"] for x in staged] == ["a", "b"]
    at = f"file://{tmp_path}/t"
    assert sinks.current(spark, at) is None
    sinks.upsert(df, at, ["record_id"])
    out = sinks.upsert(spark.createDataFrame([("a", 9, True), ("z", 0, None)], "record_id string, n int, extra boolean"), at, ["record_id"])
    assert {(r.record_id, r.n) for r in out.collect()} == {("a", 9), ("b", 1), ("c", 3), ("z", 0)} and sinks.versions(spark, at) == [1, 2]
    with pytest.raises(ValueError, match="one key"):
        sinks.upsert(df.unionByName(df), at, ["record_id"])
    assert sinks.versions(spark, at) == [1, 2]
    nodes, edges = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, type string"), spark.createDataFrame([("1", "2", "e")], "source string, target string, type string")
    sinks.write_graph(nodes, edges, f"file://{tmp_path}/g")
    assert spark.read.parquet(f"file://{tmp_path}/g/nodes").count() == 2
    with pytest.raises(ValueError, match="no node"):
        sinks.write_graph(nodes.limit(0), edges, f"file://{tmp_path}/g2")
    sinks.record_run(spark, f"file://{tmp_path}/runs", "r1", "gate", "done", 5, "2026-01-01")
    assert sinks.record_run(spark, f"file://{tmp_path}/runs", "r1", "profiles", "done", 7, "2026-01-01").count() == 2


def test_guarded_commit(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    at = f"file://{tmp_path}/g"
    assert sinks.guarded(df, df.select("n", "k").orderBy("k"), at, ["k"]).count() == 2
    for other in (df.limit(1), df.unionByName(df), df.withColumn("n", F.lit(2)), df.drop("n")):
        with pytest.raises(ValueError):
            sinks.guarded(df, other, at, ["k"])
    assert sinks.versions(spark, at) == [1]
