"""Schemas that drift between files: rescue-column ingestion and a report of every change.

``ingest`` enforces a target schema on JSON lines and keeps every unknown or uncastable field of a
line as JSON in one rescue column. ``drift`` compares each file of an account with the one before
it, over the enforced and the rescued fields of what was ingested. ``promotions`` turns reported renames
into approved fields, and ``replay`` moves their rescued values into the typed columns.

Targets have a kind: text, number or timestamp. A timestamp is enforced as ISO text with an offset; other
notations cast in ``replay``, by the zone of the line's site, if they denote one instant. Two keys of one line for one target are
allowed: the first by name is enforced, the other rescued.

Nulls, empty and unreadable lines give rows with null columns; a table without rows gives empty
results; a line that occurs twice counts twice; other columns of the input are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import instants
from skein.session import materialise

#: Least cosine of two fields' contents, in weighted character bigrams, for them to be one field
#: renamed. Between files of 20 to 40 lines, one field scores 0.3 or more, two fields 0.21 or less.
RENAME_COSINE = 0.26
#: A file has a field that is in at least this share of its readable lines.
FIELD_SHARE = 0.2

KEYS = ["table_name", "row_id", "account_id", "file_no", "file_name", "line_number"]
FILE = ["table_name", "account_id", "file_no"]
Targets = dict[str, dict[str, tuple[str, str]]]


def cast_to(kind: Column, leaf: Column) -> Column:
    """Whether a value's text is of the kind as it stands."""
    iso = leaf.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(leaf).isNotNull()
    return F.when(kind == "number", leaf.try_cast("double").isNotNull()).when(kind == "timestamp", iso).otherwise(F.lit(True))


def ingest(lines: DataFrame, targets: Targets, raw: str = "raw_line") -> DataFrame:
    """One row per line: KEYS, ``readable``, ``typed`` (target -> field, type, leaf) and ``rescued`` (key -> json, type, leaf).

    ``targets`` maps a table_name to {key as written: (target column, kind)}. A value reaches its typed
    column if it is a string or a number that casts to the kind; any other value, and every unknown key, is rescued.
    A line is parsed once, and its fields never leave its row.
    """
    # Parsed inside brackets, so that text after the object or a second object makes a line unreadable.
    rows = lines.select(*KEYS, F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]"))).alias("__v"))
    one = "CASE WHEN try_variant_get(__v, '$[1]', 'variant') IS NULL THEN try_variant_get(__v, '$[0]', 'map<string,variant>') END"
    rows = rows.select(*KEYS, F.expr(one).alias("__m"))
    held = {t: F.create_map(*[x for k, (c, kd) in m.items() for x in (F.lit(k), F.struct(F.lit(c).alias("target"), F.lit(kd).alias("kind")))]) for t, m in targets.items() if m}
    known = F.lit(None).cast("map<string,struct<target:string,kind:string>>")
    for t, m in held.items():
        known = F.when(F.col("table_name") == t, m).otherwise(known)
    rows = rows.select(*KEYS, F.col("__m").isNotNull().alias("readable"), "__m", known.alias("__k"))
    # An object's keys come in their order. The JSON of a value is written only where it is rescued.
    seen = F.expr(
        """transform(map_entries(__m), e -> struct(e.key AS field, e.value AS v, schema_of_variant(e.value) AS s, __k[e.key] AS k,
             try_variant_get(e.value, '$', 'string') AS text))"""
    )
    rows = rows.select(*KEYS, "readable", seen.alias("__e"))
    kind = (
        "CASE WHEN x.s = 'VOID' THEN 'null' WHEN x.s = 'STRING' THEN 'string' WHEN x.s = 'BOOLEAN' THEN 'boolean'"
        " WHEN x.s LIKE 'ARRAY%' THEN 'array' WHEN x.s LIKE 'OBJECT%' THEN 'object' ELSE 'number' END"
    )
    typed = F.expr(f"transform(__e, x -> struct(x.field AS field, x.v AS v, {kind} AS type, x.k AS k, x.text AS text))")
    rows = rows.select(*KEYS, "readable", typed.alias("__e"))
    fits = lambda x: F.when(x["k"].isNotNull() & x["type"].isin("string", "number") & x["text"].isNotNull(), F.when(cast_to(x["k"]["kind"], x["text"]), x["k"]["target"]))
    rows = rows.select(*KEYS, "readable", "__e", F.transform("__e", fits).alias("__t"))
    # Two keys for one target are rare; only lines that have them are searched for the first.
    named = F.filter("__t", lambda t: t.isNotNull())
    twice = F.size(F.array_distinct(named)) < F.size(named)
    clean = F.transform("__t", lambda t, i: F.when(F.array_position("__t", t) == i + 1, t))
    rows = rows.select(*KEYS, "readable", "__e", F.when(twice, clean).otherwise(F.col("__t")).alias("__t"))
    rows = rows.select(*KEYS, "readable", F.arrays_zip(F.col("__e").alias("e"), F.col("__t").alias("t")).alias("__z"))
    leaf = (
        "CASE WHEN x.e.type = 'array' THEN array_join(from_json(to_json(x.e.v), 'array<string>'), ' ')"
        " WHEN x.e.type = 'object' THEN array_join(map_values(from_json(to_json(x.e.v), 'map<string,string>')), ' ')"
        " WHEN x.e.type <> 'null' THEN coalesce(x.e.text, to_json(x.e.v)) END"
    )
    own = F.expr("map_from_entries(transform(filter(__z, x -> x.t IS NOT NULL), x -> struct(x.t, struct(x.e.field AS field, x.e.type AS type, x.e.text AS leaf))))")
    rest = F.expr(f"map_from_entries(transform(filter(__z, x -> x.t IS NULL), x -> struct(x.e.field, struct(to_json(x.e.v) AS json, x.e.type AS type, {leaf} AS leaf))))")
    return rows.select(*KEYS, "readable", own.alias("typed"), rest.alias("rescued"))


def fields_of(ingested: DataFrame) -> DataFrame:
    """The long form of what was ingested: FILE, ``field``, ``type``, ``leaf`` per readable line and field, enforced or rescued."""
    enforced = F.map_values("typed")
    rescued = F.transform(F.map_entries("rescued"), lambda e: F.struct(e["key"].alias("field"), e["value"]["type"].alias("type"), e["value"]["leaf"].alias("leaf")))
    return ingested.where("readable").select(*FILE, F.inline(F.concat(enforced, rescued)))


def file_fields(ingested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per file its readable lines; per file and field its type; and the values, in long form."""
    files = ingested.where("readable").groupBy(*FILE).agg(F.min("file_name").alias("file_name"), F.count("*").alias("n_lines"))
    before = Window.partitionBy("table_name", "account_id").orderBy("file_no")
    files = materialise(files.withColumn("prev_no", F.lag("file_no").over(before)), "files")
    values = fields_of(ingested)
    by_type = values.groupBy(*FILE, "field", "type").agg(F.count("*").alias("n"))
    known = F.when(F.col("type") != "null", F.struct("n", "type"))
    fields = by_type.groupBy(*FILE, "field").agg(F.sum("n").alias("n"), F.max(known)["type"].alias("type"))
    fields = fields.join(files, FILE).where(F.col("n") >= FIELD_SHARE * F.col("n_lines"))
    return files, materialise(fields, "fields"), values


def rename_scores(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` with ``cosine``: how alike the old field's values in the file before are to the new
    field's values in the file, in character bigrams with the ends of a value marked."""
    at = ["table_name", "account_id"]
    sides = pairs.select(*at, F.col("prev_no").alias("file_no"), F.col("old_field").alias("field")).unionByName(
        pairs.select(*at, "file_no", F.col("new_field").alias("field"))
    )
    text = F.concat(F.lit("^"), F.col("leaf"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    held = values.where(F.col("leaf").isNotNull()).join(sides.distinct(), [*at, "file_no", "field"], "left_semi")
    counts = held.select(*at, "file_no", "field", F.explode(F.array_distinct(grams)).alias("g")).groupBy(*at, "file_no", "field", "g")
    weights = counts.agg(F.sqrt(F.count("*")).alias("w"))
    # A bigram found in many kinds of field, such as two digits, says little of one.
    kinds = weights.select("table_name", "field", "g").distinct()
    rare = kinds.sparkSession.sql(
        "SELECT g, ln(1 + (SELECT count(DISTINCT table_name, field) FROM {kinds}) / count(*)) AS idf FROM {kinds} GROUP BY g", kinds=kinds
    )
    weights = weights.join(rare, "g").withColumn("w", F.col("w") * F.col("idf")).drop("idf")
    norms = weights.groupBy(*at, "file_no", "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = weights.join(norms, [*at, "file_no", "field"]).withColumn("w", F.col("w") / F.col("norm")).drop("norm")
    a = weights.select(*at, F.col("file_no").alias("prev_no"), F.col("field").alias("old_field"), "g", F.col("w").alias("wa"))
    b = weights.select(*at, "file_no", F.col("field").alias("new_field"), "g", F.col("w").alias("wb"))
    key = [*at, "file_no", "prev_no", "old_field", "new_field"]
    score = pairs.select(*key).join(a, [*at, "prev_no", "old_field"]).join(b, [*at, "file_no", "new_field", "g"])
    return score.groupBy(*key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def drift(ingested: DataFrame) -> DataFrame:
    """Every change of a field between a file and the one before it by ``file_no``, within one table
    and account: ``change_kind`` is added, removed, renamed (with its ``cosine``) or type_changed.

    Renames are assigned greedily by falling cosine among a file's added and removed fields, ties by
    the fields' names; a field takes part in one rename at most.
    """
    files, fields, values = file_fields(ingested)
    at = FILE
    names = files.where("prev_no IS NOT NULL").select(*at, "prev_no", "file_name")
    cur = fields.where("prev_no IS NOT NULL").select(*at, "field", F.col("type").alias("new_type"))
    prev = fields.select("table_name", "account_id", F.col("file_no").alias("prev_no"), "field", F.col("type").alias("old_type"))
    prev = prev.join(names.select(*at, "prev_no"), ["table_name", "account_id", "prev_no"]).drop("prev_no")
    both = materialise(cur.withColumn("here", F.lit(True)).join(prev.withColumn("there", F.lit(True)), [*at, "field"], "full"), "both")
    added = both.where("there IS NULL").select(*at, F.col("field").alias("new_field"), "new_type")
    removed = both.where("here IS NULL").select(*at, F.col("field").alias("old_field"), "old_type")
    pairs = added.join(removed, at).join(names, at)
    scores = rename_scores(pairs, values).where(F.col("cosine") >= RENAME_COSINE)
    greedy = F.expr(
        """aggregate(array_sort(collect_list(struct(-round(cosine, 9) AS c, old_field AS o, new_field AS n))),
             CAST(array() AS array<struct<c:double,o:string,n:string>>),
             (acc, x) -> IF(exists(acc, y -> y.o = x.o OR y.n = x.n), acc, concat(acc, array(x))))"""
    )
    renamed = scores.groupBy(*at).agg(greedy.alias("picked")).select(*at, F.inline("picked")).select(
        *at, F.col("o").alias("old_field"), F.col("n").alias("new_field"), (-F.col("c")).alias("cosine")
    )
    renamed = materialise(renamed, "renamed")
    a = added.join(renamed, [*at, "new_field"], "left").withColumn("found", F.col("old_field").isNotNull())
    r = removed.join(renamed, [*at, "old_field"], "left")
    types = a.where("found").join(removed, [*at, "old_field"])
    kept = both.where("here AND there AND new_type <> old_type")
    say = lambda d, kind, old, new: d.select(
        *at, F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"), (F.col("cosine") if kind == "renamed" else F.lit(None).cast("double")).alias("cosine")
    )
    none, old, new = F.lit(""), F.col("old_field"), F.col("new_field")
    changes = (
        say(a.where("NOT found"), "added", none, new)
        .unionByName(say(r.where("new_field IS NULL"), "removed", old, none))
        .unionByName(say(a.where("found"), "renamed", old, new))
        .unionByName(say(types.where("new_type <> old_type"), "type_changed", old, new))
        .unionByName(say(kept, "type_changed", F.col("field"), F.col("field")))
    )
    return changes.join(names.select(*at, "file_name"), at)


def promotions(changes: DataFrame, targets: Targets, register: DataFrame | None = None, least: float = RENAME_COSINE) -> DataFrame:
    """The approved fields: (table_name, account_id, field, target) for every key that a chain of
    approved renames leads to from a target's key. Only rename events are grouped, a few per file.

    A rename is approved by ``register`` (table_name, old_field, new_field, approved), the decisions of whoever
    owns the schema; one the register does not name is approved if its cosine is ``least`` or more.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        table, account = pdf["table_name"].iloc[0], pdf["account_id"].iloc[0]
        now = {k: c for k, (c, _) in targets.get(table, {}).items()}
        for old, new in pdf.sort_values(["file_no", "old_field", "new_field"])[["old_field", "new_field"]].itertuples(index=False):
            if old in now:
                now.setdefault(new, now[old])
        rows = [(table, account, k, v) for k, v in now.items()]
        return pd.DataFrame(rows, columns=["table_name", "account_id", "field", "target"])

    events = changes.where("change_kind = 'renamed'").select("table_name", "account_id", "file_no", "old_field", "new_field", "cosine")
    said = F.lit(None).cast("boolean")
    if register is not None:
        events = events.join(register.select("table_name", "old_field", "new_field", "approved"), ["table_name", "old_field", "new_field"], "left")
        said = F.col("approved")
    events = events.where(F.coalesce(said, F.col("cosine") >= least)).select("table_name", "account_id", "file_no", "old_field", "new_field")
    return events.groupBy("table_name", "account_id").applyInPandas(follow, "table_name string, account_id string, field string, target string")


def replay(ingested: DataFrame, approved: DataFrame, targets: Targets, zones: DataFrame | None = None) -> DataFrame:
    """The consistent table: KEYS, ``readable``, a column per target, of its kind, and ``rescued`` (JSON, null
    if nothing is left in it). A rescued value moves into its typed column if its key is approved, or is a target's
    own, if it casts to the column's kind, and if the column has no value; the first by key's name wins. All others stay rescued.
    ``zones`` (table_name, row_id, zone) has the zones of the lines' sites, for timestamps without zone."""
    own = ingested.sparkSession.createDataFrame(
        [(t, k, c) for t, m in targets.items() for k, (c, _) in m.items()], "table_name string, field string, own string"
    )
    kinds = {c: kd for m in targets.values() for c, kd in m.values()}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rescued = ingested.select("table_name", "row_id", "account_id", "typed", F.explode("rescued").alias("field", "v"))
    to = F.coalesce("target", "own")
    fits = to.isNotNull() & F.col("v.leaf").isNotNull() & ~F.map_contains_key("typed", F.coalesce(to, F.lit("")))
    moved = rescued.join(approved, ["table_name", "account_id", "field"], "left").join(own, ["table_name", "field"], "left")
    moved = moved.join(zones, ["table_name", "row_id"], "left") if zones is not None else moved.withColumn("zone", F.lit(None).cast("string"))
    moved = moved.select("table_name", "row_id", "field", "v", "zone", F.when(fits, to).alias("to"))
    timed = instants.to_instants(moved.withColumn("stamp", F.when(kind[F.col("to")] == "timestamp", F.col("v.leaf"))), "stamp", "zone")
    whole = F.when(kind[F.col("to")] == "timestamp", F.col("epoch_ms").isNotNull()).otherwise(cast_to(kind[F.col("to")], F.col("v.leaf")))
    utc = F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_millis("epoch_ms"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    moved = timed.select("table_name", "row_id", "field", F.when(whole, F.col("to")).alias("to"), F.coalesce(utc, F.col("v.leaf")).alias("leaf"), F.col("v.json").alias("json"))
    first = Window.partitionBy("table_name", "row_id", "to").orderBy("field")
    moved = moved.withColumn("to", F.when(F.row_number().over(first) == 1, F.col("to")))
    back = moved.groupBy("table_name", "row_id").agg(
        F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("to", "leaf"))))).alias("moved"),
        F.collect_list(F.when(F.col("to").isNull(), F.struct("field", "json"))).alias("left_over"),
    )
    out = ingested.select(*KEYS, "readable", "typed").join(back, ["table_name", "row_id"], "left")
    name = lambda x: F.to_json(F.array(x["field"]))
    member = lambda x: F.concat(name(x).substr(F.lit(2), F.length(name(x)) - 2), F.lit(":"), x["json"])
    rest = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort("left_over"), member), ","), F.lit("}"))
    text = lambda c: F.coalesce(F.col("typed")[c]["leaf"], F.col("moved")[c])
    as_kind = {"text": lambda x: x, "number": lambda x: x.try_cast("double"), "timestamp": lambda x: F.try_to_timestamp(x)}
    return out.select(*KEYS, "readable", *[as_kind[kinds[c]](text(c)).alias(c) for c in sorted(kinds)], F.when(F.size("left_over") > 0, rest).alias("rescued"))
