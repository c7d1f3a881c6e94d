"""Session helpers: a configured local session for tests/bench and the
checkpoint directory lookup every lineage cut goes through."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on: UTC wall time (dates are compared as
# naive wall time, like the text dates of the source data), ANSI casts, AQE
# (runtime coalescing and skew-join splitting).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "repolens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``repolens`` importable in the executors' Python workers
    (``mapInPandas`` functions refer to it): zip the package once per
    SparkContext and add it with ``addPyFile``, which distributes it to
    every executor."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="repolens-pkg-")
    zpath = os.path.join(folder, "repolens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "repolens")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


# Shuffled data that Spark puts into one task when it joins small partitions
# (its default: 64m).  Rows of long repeated names take some 25 times their
# shuffled size in a task's sorts and hash tables.
TASK_SHUFFLE = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def ensure_query_conf(spark: SparkSession) -> None:
    """Pin the settings the query semantics depend on (time zone only;
    the rest are performance settings the cluster may override) and ship
    the package to the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(TASK_SHUFFLE[0], None) is None:
        spark.conf.set(*TASK_SHUFFLE)
    ship_package(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it.  Only when
    it is unset (tests, local bench) a scratch folder is created and set.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not d and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(d or tempfile.mkdtemp(prefix="repolens-ckpt-"))
    # Spark makes a folder of its own below the one that is set
    return d or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives an
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``, none if it does not exist;
    an error of access is raised, not taken for an empty folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
