"""Session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the bench and the driver entry point.  Cluster settings
(executor sizing, ``spark.checkpoint.dir``) come from the deployment and are
only filled in here when they are unset.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on.  AQE re-plans joins at runtime
# (it turns a shuffle join into a broadcast join only after it has *measured*
# the small side), coalesces small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(
    master: str | None = None,
    app_name: str = "tallyframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf.setdefault("spark.driver.memory", "8g")   # local mode: the driver is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared filesystem path set by the deployment; if
    it is unset there, this raises.  Only in local mode (tests) is a private
    scratch folder created.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def set_conf(spark: SparkSession, key: str, value: str):
    """A setting of the session for the work inside; given back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate
    tables and streaming checkpoints."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tallyframe", name)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, through Hadoop's FileSystem API (so
    local, HDFS and object-store paths all work)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete sub-folders of a folder: those with _SUCCESS."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getParent().getName() for s in fs.globStatus(found) or [])


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def file_stamps(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of the files of tables (files or folders): they
    change when a table is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        for pattern in (path, f"{path}/*"):
            p = jvm.org.apache.hadoop.fs.Path(pattern)
            for s in p.getFileSystem(conf).globStatus(p) or []:
                out.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return "|".join(sorted(out))
