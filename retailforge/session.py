"""Session helpers.

On a cluster the session is handed to us; we only add SQL settings the jobs
rely on (UTC session zone, AQE) and ship the package to the Python workers.
``spark.checkpoint.dir`` is read from the session; a local master without it
gets a temporary folder (tests), any other master raises.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "retailforge",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.driver.memory", os.environ.get("RF_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _SQL_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Pin the SQL settings the jobs assume (zone UTC, AQE on) and ship the package once."""
    for k, v in _SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers through Spark's own file server, once per context.

    Functions run in ``applyInPandas`` / ``mapInArrow`` are pickled by
    reference, so workers must be able to import the package wherever the
    driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_retailforge_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rf-ship-"), "retailforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("retailforge", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._retailforge_shipped = True


def is_local(master: str) -> bool:
    """True for ``local`` and ``local[...]``: driver and executors are one process on one disk."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a temporary folder only on a local master."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="rf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written table under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/retailforge-stages/{name}-{uuid.uuid4().hex}"


def stage(df, name: str = "stage"):
    """Materialise ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage between pipeline stages (the reference exchanged files
    between its scripts too): downstream branches scan the written table
    instead of recomputing the upstream joins, and a lost executor only
    costs the tasks of the current stage.  Parquet keeps column pruning and
    filter pushdown on the re-read.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._stage_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``stage_path``; any other path is refused."""
    if "/retailforge-stages/" not in path:
        raise ValueError(f"not a stage folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames) -> None:
    """Delete the folders of frames returned by ``stage`` that no returned frame reads any more."""
    for df in frames:
        discard(df.sparkSession, df._stage_path)
