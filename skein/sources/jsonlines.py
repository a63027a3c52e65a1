"""JSON-lines sources: bad lines are kept apart, never lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_lines(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, plus ``obj`` (VARIANT of the line's object) and ``readable``.

    A line is readable if it is exactly one JSON object. The line is parsed inside brackets, so
    that text after the object or a second object makes it unreadable; null and empty lines are
    unreadable too. Bad lines stay as rows with a null ``obj``.
    """
    v = F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]")))
    one = F.expr("try_variant_get(__v, '$[0]', 'variant')")
    is_one = F.expr(
        "__v IS NOT NULL AND try_variant_get(__v, '$[1]', 'variant') IS NULL"
        " AND schema_of_variant(try_variant_get(__v, '$[0]', 'variant')) LIKE 'OBJECT<%'"
    )
    out = df.select(*keep, v.alias("__v"))
    ok = F.coalesce(is_one, F.lit(False))
    return out.select(*keep, F.when(ok, one).alias("obj"), ok.alias("readable"))


def explode_fields(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """A row per readable line and top-level key: ``field``, ``json`` (the value as JSON), ``type``
    (string, number, boolean, array, object, null) and ``leaf`` (its text, without structure)."""
    spark = parsed.sparkSession
    cols = ", ".join(f"t.`{c}`" for c in keep)
    rows = spark.sql(
        f"SELECT {cols}, e.key AS field, to_json(e.value) AS json, schema_of_variant(e.value) AS __s,"
        " try_variant_get(e.value, '$', 'string') AS __text"
        " FROM {t} t, LATERAL variant_explode(t.obj) e",
        t=parsed.where("readable"),
    )
    kind = (
        F.when(F.col("__s") == "VOID", "null")
        .when(F.col("__s") == "STRING", "string")
        .when(F.col("__s") == "BOOLEAN", "boolean")
        .when(F.col("__s").startswith("ARRAY"), "array")
        .when(F.col("__s").startswith("OBJECT"), "object")
        .otherwise("number")
    )
    items = F.array_join(F.from_json("json", "array<string>"), " ")
    members = F.array_join(F.map_values(F.from_json("json", "map<string,string>")), " ")
    inner = F.when(kind == "array", items).otherwise(members)
    leaf = F.when(kind.isin("array", "object"), inner).when(kind != "null", F.coalesce("__text", "json"))
    return rows.select(*keep, "field", "json", kind.alias("type"), leaf.alias("leaf"))
