"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._quillspark_shipped = True
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where that is unset and everything
    runs on this machine (as in tests) is a temporary folder set instead; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing can be removed through it
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table below the shared folder and read it back.

    Cuts the lineage with a file that survives the loss of executors, keeps column pruning,
    and frees the shuffle files of the finished job. The table is removed by `discard`, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"
    with_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"},
              lambda: df.write.option("compression", "zstd").parquet(path))
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


_WRITTEN: dict[str, SparkSession] = {}


def discard(df: DataFrame) -> None:
    """Remove the table that `materialize` wrote for df, once nothing reads it any more."""
    path = getattr(df, "_quillspark_path", None)
    if path in _WRITTEN:
        _remove(_WRITTEN.pop(path), path)


def stands(df: DataFrame) -> bool:
    """Whether the table that `materialize` wrote for df is still there."""
    path, sc = getattr(df, "_quillspark_path", None), df.sparkSession.sparkContext
    if path is None:
        return False
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        _remove(spark, path)


def with_conf(spark: SparkSession, settings: dict[str, str], action):
    """Run action under the given session settings and put the old ones back."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return action()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return ship(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
