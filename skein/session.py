"""Session factory and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; a cluster's own settings win.

    The number of shuffle partitions is set only where this call names a local master.
    """
    b = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    if master:
        b = b.master(master)
        if master.startswith("local"):
            defaults["spark.sql.shuffle.partitions"] = "8"
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, as in local tests, a temporary folder is made, set for the session's lifetime
    and removed at exit. On a cluster that would be another folder on each machine, so there an
    unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset under {master}: set it to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, found[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/skein-{spark.sparkContext.applicationId}"


#: Folders of written intermediate tables that exist still.
_written: set[str] = set()


def materialise(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage like checkpoint() and survives the loss of an executor, but computes the
    plan once (an RDD checkpoint computes it twice) and keeps the columnar form, so that later
    reads prune columns. ``discard`` removes the table when it is no longer read; what is left is
    removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not _written:
        atexit.register(_sweep, spark)
    _written.add(path)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no plan still to be run reads."""
    for df in tables:
        path = getattr(df, "_skein_path", None)
        if path in _written:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def _sweep(spark: SparkSession) -> None:
    for path in list(_written):
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
