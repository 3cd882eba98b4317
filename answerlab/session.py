"""Session helpers: table loading, lineage cuts in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of at most two short columns may be broadcast (some 64 MB).
BROADCAST_ROWS = 1_000_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("answerlab")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python must import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="answerlab-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "answerlab_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*")):
            if f.is_file() and f.suffix != ".pyc":
                out.write(f, f.relative_to(root.parent))
    context.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only on one machine, where the session may have none, is a temporary folder made and set; a cluster without a shared folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="answerlab-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/answerlab-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    else:
        atexit.register(_drop_remote, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._answerlab_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, and the shuffles that have been read."""
    for df in tables:
        _drop_remote(df.sparkSession, df._answerlab_path)
    sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Delete the shuffles of plans that are gone: the JVM's cleaner does so when Python and then the JVM collect their garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop_remote(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder's owner sweeps it
        pass


class Files:
    """Files of any file system that the cluster knows, by path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)

    def copy(self, source: str, target: str) -> None:
        """Copy a folder, to another file system too."""
        a, b = self.path(source), self.path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(self.conf), a, b.getFileSystem(self.conf), b, False, self.conf)

    def rename(self, source: str, target: str) -> None:
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be renamed to {target}")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def semi_join_checked(df: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``: a broadcast below ``rows`` keys, a shuffle beyond.

    ``keys`` should be materialised: it is counted first.
    """
    side = keys.select(on)
    return df.join(F.broadcast(side) if small_enough(side, rows) else side, on, "left_semi")


def spread(scan: DataFrame, per_scan_partition: int = 4, least: int = 32) -> int:
    """Number of shards for work that is split by content: grows with the partitions of a plain scan."""
    floor = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, floor, per_scan_partition * scan._jdf.queryExecution().toRdd().getNumPartitions())
