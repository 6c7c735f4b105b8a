"""Session helpers shared by all operators: table access, checkpoint folder, shipping the package to workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (``spark.checkpoint.dir``). Only a session whose tasks run in the driver's own process, as in tests, may do without:
    it gets a private folder, which goes with the process. On a cluster a folder of one machine would lose what others write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliospark-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever the driver's import path is. Once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_foliospark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="foliospark-src-"), "foliospark_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("foliospark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._foliospark_shipped = True


#: Rows up to which a materialised relation of narrow rows (a few numbers or a word, up to some 64 bytes) may be broadcast: 64 MB at most. It changes the
#: plan only; beyond, the same join is a shuffle.
BROADCAST_ROWS = 1_000_000
