"""Sinks: rows by destination, graphs, versioned upserts and a ledger of runs. A sink that fails leaves the version before it in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_routed(df: DataFrame, path: str, destination: str = "destination", order: str = "record_id") -> None:
    """JSON lines per destination (staged, review, quarantine …), each file sorted by ``order``."""
    df.sortWithinPartitions(destination, order).write.mode("overwrite").partitionBy(destination).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (id, type, …) and edges (source, target, type, …) as Parquet by type. An edge whose ends are not among the nodes is an error."""
    ids = nodes.select("id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if not ends.join(ids, "id", "left_anti").isEmpty():
        raise ValueError("an edge has an end that is no node")
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, rising."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v") and done(x.getPath()))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def upsert(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """A new version of the table with ``df``'s rows in place of those of the same key, and columns of both; the table as it then is.
    Two rows of ``df`` with one key are an error."""
    spark = df.sparkSession
    if not df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"two rows have one key {key}")
    old = current(spark, path)
    new = df if old is None else df.unionByName(old.join(df.select(*key), key, "left_anti"), allowMissingColumns=True)
    number = (versions(spark, path) or [0])[-1] + 1
    new.write.mode("overwrite").parquet(f"{path}/v{number}")
    return spark.read.parquet(f"{path}/v{number}")


def record_run(spark: SparkSession, path: str, run_id: str, step: str, status: str, rows: int, at: str) -> DataFrame:
    """Append a line to the ledger of runs; the ledger as it then is."""
    line = spark.createDataFrame([(run_id, step, status, rows, at)], "run_id string, step string, status string, n_rows bigint, at string")
    line.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def guarded(declared: DataFrame, recomputed: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Upsert ``declared`` if it is exactly what was recomputed from the raw evidence, repeats included; else an exception and no change."""
    columns = sorted(declared.columns)
    if sorted(recomputed.columns) != columns:
        raise ValueError("the columns differ")
    a, b = declared.select(*columns), recomputed.select(*columns)
    both = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1)))
    # One aggregation instead of two set differences.
    if not both.groupBy(*columns).agg(F.sum("__d").alias("__d")).where("__d <> 0").isEmpty():
        raise ValueError("what was declared is not what the evidence gives")
    return upsert(declared, path, key)
