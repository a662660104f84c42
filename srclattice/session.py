"""The Spark session, and how the workers get this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows that go to Python at once, where the session has not set it: with texts of 100,000 characters, Spark's 10,000 rows would be 1 GB.
ARROW_ROWS = "1000"


def session(name: str = "srclattice", master: str | None = None) -> SparkSession:
    """A session with adaptive execution; without a master, the cluster's own setting counts."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(max(8, os.cpu_count() or 8))).config("spark.ui.enabled", "false")
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once for each application."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="srclattice-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="srclattice-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
            pass


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/srclattice-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Levels:
    """Tables of one schema in a folder of their own, written one by one and read as one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths, self.schema = spark, own_folder(spark, name), [], None

    def add(self, df: DataFrame) -> DataFrame:
        self.schema = self.schema or df.schema
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.read(self.paths[-1:])

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)
