"""Tables in the folder that all executors share, and what Python workers need to import the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when neither PYTHONPATH nor the working folder does."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(_ROOT) in [*paths, os.getcwd()] or getattr(sc, "_porelake_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "porelake_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (_ROOT / "porelake").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._porelake_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session whose tasks
    all run in the driver's own process gets a temporary folder; a cluster gets an error, as each
    executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="porelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{scratch_dir(spark)}/porelake/{tag}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Delete what operators wrote to the shared folder. Their results read it lazily, so call this
    once these are written; results of other running jobs of the same folder would be lost too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/porelake")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, lost executors
    cost nothing that was written, and later readers prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
