"""Files of records: JSON lines, JSON arrays and objects, CSV, exports with many headers, manifests, plain documents.

A record that cannot be read stays as a row with an ``error``; ``strict`` turns any such row into an exception. Bounds on
lines, files, records and depth are errors too, never cuts. Empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_BYTES, FILE_BYTES, FILE_RECORDS, DEPTH = 1 << 20, 25 << 20, 10_000, 50
RECORD = ["file", "line_number", "raw", "error"]
#: The one JSON value of a text, null if there is none or anything after it: the parser alone would stop after the first.
ONE = "CASE WHEN try_variant_get(try_parse_json('[' || {0} || ']'), '$[1]', 'variant') IS NULL THEN try_variant_get(try_parse_json('[' || {0} || ']'), '$[0]', 'variant') END"


def depth(raw: Column) -> Column:
    """How deep the brackets of a JSON text nest, those in strings aside."""
    signs = F.regexp_replace(F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = F.transform(F.filter(F.split(signs, ""), lambda x: x != ""), lambda x: F.when(x.isin("[", "{"), 1).otherwise(-1))
    run = F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")))
    return run["most"]


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of files of one object per line; ``line_number`` counts from 1, empty lines included but not returned."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n", -1)).alias("at", "raw")).where(F.trim("raw") != "")
    ok = F.expr(f"schema_of_variant({ONE.format('raw')}) LIKE 'OBJECT<%'")
    return lines.select("file", (F.col("at") + 1).alias("line_number"), "raw", F.when(~F.coalesce(ok, F.lit(False)), "invalid_json").alias("error"))


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of files that hold one JSON array of objects, or one object; ``line_number`` is the item's number.
    A file that is neither, or has anything after it, is one row in error, as is an item that is no object."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    read = whole.select("file", F.expr(ONE.format("value")).alias("v"), "value").withColumn("kind", F.expr("schema_of_variant(v)"))
    items = spark.sql(
        """SELECT file, e.pos + 1 AS line_number, to_json(e.value) AS raw, CASE WHEN schema_of_variant(e.value) LIKE 'OBJECT<%' THEN NULL ELSE 'invalid_record' END AS error
           FROM {r} r, LATERAL variant_explode(r.v) e WHERE kind LIKE 'ARRAY<%'""", r=read)
    single = read.where("kind LIKE 'OBJECT<%'").select("file", F.lit(1).alias("line_number"), F.to_json("v").alias("raw"), F.lit(None).cast("string").alias("error"))
    bad = read.where("kind IS NULL OR NOT (kind LIKE 'ARRAY<%' OR kind LIKE 'OBJECT<%')").where("trim(value) <> ''")
    return items.unionByName(single).unionByName(bad.select("file", F.lit(1).alias("line_number"), F.col("value").alias("raw"), F.lit("invalid_json").alias("error")))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of CSV files with a header: each row as a JSON object of texts; the first row of data is line 2.
    A row of more or fewer cells than the header is in error."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names) + ", `__bad` string"
    rows = spark.read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("multiLine", True).schema(schema).csv(path)
    rows = rows.withColumn("file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    at = F.row_number().over(Window.partitionBy("file").orderBy("__at"))  # a file is read by one task
    packed = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return rows.select("file", (at + 1).alias("line_number"), packed.alias("raw"), F.when(F.col("__bad").isNotNull(), "wrong_cell_count").alias("error"))


def bounded(records: DataFrame, line_bytes: int = LINE_BYTES, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS, most: int = DEPTH) -> DataFrame:
    """RECORD rows with an ``error`` where a bound is passed: the line's, the depth's, or, for all its rows, the file's."""
    files = records.groupBy("file").agg(F.sum(F.octet_length("raw") + 1).alias("__bytes"), F.count("*").alias("__n"))
    joined = records.join(files, "file")
    own = F.when(F.octet_length("raw") > line_bytes, "line_too_long").when(depth(F.col("raw")) > most, "too_deep")
    all_of = F.when(F.col("__bytes") > file_bytes, "file_too_large").when(F.col("__n") > file_records, "too_many_records")
    return joined.select("file", "line_number", "raw", F.coalesce("error", own, all_of).alias("error"))


def strict(records: DataFrame) -> DataFrame:
    """The records, or an exception that names the first ten in error."""
    bad = records.where("error IS NOT NULL").orderBy("file", "line_number").select("file", "line_number", "error").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}:{r['line_number']}: {r['error']}" for r in bad))
    return records


def unique(records: DataFrame, key: str) -> DataFrame:
    """The records, or an exception if two have one ``key`` (a top-level field of ``raw``), or one has none."""
    held = records.select(F.get_json_object("raw", f"$.{key}").alias("k"))
    again = held.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").orderBy("k").limit(10).collect()
    if again:
        raise ValueError("repeated or missing: " + ", ".join(str(r["k"]) for r in again))
    return records


def exported(records: DataFrame, aliases: dict[str, list[str]], offset: int = 0, limit: int | None = None) -> DataFrame:
    """RECORD columns and one per target: the first of its headers that has a text, headers compared without case, spaces and
    underscores. A cell that a spreadsheet would run as a formula, and two headers of one name, are errors. Records are
    paged per file by their order."""
    fields = F.from_json("raw", "map<string,string>")
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s_]+", ""))
    names = F.transform(F.map_keys(fields), plain)
    flat = F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(plain(e["key"]), e["value"])))
    twice = F.size(F.array_distinct(names)) < F.size(names)
    formula = F.exists(F.map_values(fields), lambda v: F.coalesce(v.rlike(r"^\s*[=@]|^\s*[+\-](?![\d.,\s]*$)"), F.lit(False)))
    d = records.select(*RECORD, F.when(~F.coalesce(twice, F.lit(False)), flat).alias("__f"), F.when(twice, "duplicate_header").when(formula, "formula_cell").alias("__e"))
    value = lambda keys: F.coalesce(*[F.nullif(F.trim(F.col("__f")[k.lower().replace(" ", "").replace("_", "")]), F.lit("")) for k in keys])
    d = d.select("file", "line_number", "raw", F.coalesce("error", "__e").alias("error"), *[value(k).alias(c) for c, k in aliases.items()])
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_number"))
    d = d.withColumn("__r", rank).where(F.col("__r") > offset)
    return (d.where(F.col("__r") <= offset + limit) if limit is not None else d).drop("__r")


def pointed(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``manifest`` (id, inline, path) with ``text``: the inline text, or that of the file of the folder it points at; ``error``
    where there is neither, both, or no such file. A path must stay in the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), "^file:/*", "/")
    held = files.select(F.substring(F.regexp_replace("path", "^file:/*", "/"), F.length(root) + 1, F.lit(1 << 20)).alias("path"), F.decode("content", "UTF-8").alias("__t"))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    d = manifest.join(held, "path", "left")
    wrong = F.when(has("inline") & has("path"), "two_texts").when(~has("inline") & ~has("path"), "no_text").when(F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)|^/"), "outside_folder").when(has("path") & F.col("__t").isNull(), "missing_file")
    return d.select("id", F.when(wrong.isNull(), F.coalesce(F.when(has("inline"), F.col("inline")), F.col("__t"))).alias("text"), wrong.alias("error"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of the .txt and .md files of a folder; other kinds are rows in error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    plain = F.lower("path").rlike(r"\.(?:txt|md)$")
    return files.select("path", F.when(plain, F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")).alias("text"), F.when(~plain, "unknown_kind").alias("error"))
