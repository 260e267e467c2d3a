"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vellumflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides any of them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()
_folders: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, so that it need not be installed on them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-vellumflow-"), "vellumflow.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        at = os.path.join(folder, f)
                        z.write(at, os.path.relpath(at, os.path.dirname(top)))
        spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only a master in one process may do without and gets a local one; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_before.get() if set_before.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-vellumflow-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def working_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder for intermediate rows; all of an application's are removed when the driver ends or by :func:`clear_saved`."""
    folder = f"{shared_dir(spark)}/vellumflow/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        if not _folders:
            atexit.register(_clear_all, spark)
        _folders.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def clear_saved(spark: SparkSession) -> None:
    """Remove the intermediate files of this application. DataFrames that were not written or collected before can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    for folder in sorted(_folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _folders.clear()


def _clear_all(spark: SparkSession) -> None:
    try:
        clear_saved(spark)
    except Exception:  # the session has ended; what is left can be deleted by hand
        pass


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage, so that a lost executor costs the re-read of a file and not a re-run of the job, and lets
    several consumers share one computation.
    """
    spark = df.sparkSession
    path = working_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """The same as a table bucketed by ``key``: rows joined to it by ``key`` in as many partitions travel, its own rows stay."""
    spark = df.sparkSession
    name = f"vellumflow_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", working_path(spark, tag)).format("parquet").saveAsTable(name)
    return spark.table(name)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
