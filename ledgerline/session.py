"""Spark session and scratch-location helpers.

Every operator takes the caller's ``SparkSession``; this module only builds
one for tests, benches and the driver entry point, and resolves the shared
checkpoint folder a cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Only used when the session has no checkpoint folder of its own (tests).
_LOCAL_FALLBACK_DIR = "/tmp/ledgerline-checkpoints"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerline") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE re-plans joins and coalesces shuffle partitions at run time, the
    session time zone is pinned to UTC, and the web UI stays off.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Checkpoints written to cut lineage are removed once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        target = _LOCAL_FALLBACK_DIR
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerline-{name}-{uuid.uuid4().hex[:12]}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its own file system (any other failure to look is raised)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def create_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is already there. Of several callers, only one gets True.

    Rests on the file system's exclusive create (HDFS, local disks and object
    stores with conditional writes have it).
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            os.close(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if fs.exists(target):
            return False
        raise error
    return True


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerline`` importable in Python workers (once per SparkContext).

    Pandas UDFs and grouped-map functions are pickled by reference to their
    module, so executors need the package: it is zipped and added with
    ``addPyFile``, which Spark distributes to every executor.
    """
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = scratch_path(spark, "pyfiles")
    if target.startswith("file:"):
        target = target[len("file:"):]
    if "://" in target:  # a remote shared folder: stage the archive on the driver, Spark ships it
        import tempfile
        target = tempfile.mkdtemp(prefix="ledgerline-pyfiles-")
    os.makedirs(target, exist_ok=True)
    archive = os.path.join(target, "ledgerline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, fnames in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for fn in fnames:
                if fn.endswith(".py"):
                    full = os.path.join(root, fn)
                    zf.write(full, os.path.join("ledgerline", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
