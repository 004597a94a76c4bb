"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="ridgeline-py-"), "ridgeline.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names. Only a local session may do with a scratch one: elsewhere each node has its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ridgeline-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def joinable(df: DataFrame, n: int, most: int) -> DataFrame:
    """For a join: a table of ``n`` rows goes by broadcast if they are at most ``most``, else by a merge join."""
    return F.broadcast(df) if n <= most else df.hint("merge")


def tasks_for(spark: SparkSession, n: int) -> int:
    """Tasks for ``n`` rows of which each is much work: small tables would else be put into one task for their few bytes."""
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 32)))


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
