"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started with it on their path."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) in paths or any("braidwork" in f for f in spark.sparkContext._python_includes):
        return
    archive = Path(tempfile.mkdtemp(prefix="braidwork-code-")) / "braidwork.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"braidwork/{p.relative_to(ROOT)}")
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table by its folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master a temporary one where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='braidwork-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_made: list[tuple[SparkSession, str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs no more than re-reading the
    files, and two consumers of the result do not compute it twice.  The
    shuffle files behind the table go once it is written, rather than when the
    driver next collects its garbage.  release() deletes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that written() has made; results not yet read need them.

    A long session calls it once it has read or stored its results; it also
    runs when the interpreter ends.
    """
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; nothing is left to do then
            return


atexit.register(release)
