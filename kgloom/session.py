"""Session helpers: tables, the shared folder, and materialised intermediate tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str = "local[*]", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and local runs; on a cluster the caller's session is used as it is."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, where their path would not find it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    if root in {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="kgloom-"), "kgloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "kgloom")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(path := os.path.join(folder, n), os.path.relpath(path, root))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, by Spark's reader alone."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in this one process (local tests) a temporary folder is made and set; on a
    cluster without such a folder RuntimeError is raised, as executors and driver would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kgloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts lineage: what follows reads files that outlive any executor, with their own sizes for AQE.
    """
    path = f"{shared_dir(spark)}/kgloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def cached(spark: SparkSession, make, key: str, folder: str | None = None) -> DataFrame:
    """make()'s table, read through a Parquet cache named by the digest of key (a version, a config, a file's identity).

    A table counts as there once its writer has marked it whole, so that a broken write is made again.
    """
    path = f"{folder or shared_dir(spark) + '/kgloom/cache'}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows up to which a side of a join is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where a count, stopped at SMALL, proves it small; else without, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def discard(*tables: DataFrame) -> None:
    """Removes the files of staged tables that no later step reads. What was derived from them must be staged by then."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
