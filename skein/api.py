"""One object for a folder of tables: its tables as views, its queries by name."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from skein.plans import registry


class Engine:
    """``Engine(spark, folder)``: ``tables()``, ``queries()``, ``run(name)`` and ``sql(text)`` over the folder's tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def tables(self) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))

    def queries(self) -> list[str]:
        return sorted(registry.QUERIES)

    def run(self, name: str) -> DataFrame:
        return registry.QUERIES[name](self.spark, self.folder)

    def sql(self, text: str) -> DataFrame:
        """A query over the folder's tables, each under its own name."""
        for t in self.tables():
            self.spark.read.parquet(f"{self.folder}/{t}.parquet").createOrReplaceTempView(t)
        return self.spark.sql(text)
