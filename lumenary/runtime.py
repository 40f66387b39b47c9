"""What every part needs of the session: code on the executors, a reliable checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as a zip file.

    Arrow batches are kept small, as texts are long: each task holds a few of them outside the heap.
    """
    sc = spark.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):  # a size that was set on purpose stays
        spark.conf.set(BATCH, 2_000)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lumenary-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"lumenary-{sc.applicationId}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only a local master, as in tests, may have none; it gets a new folder of this machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lumenary-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one for intermediate tables; it goes when the application ends."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder; its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt to tasks by its keys; as it is if tasks is None."""
    return df.repartition(tasks, *keys) if tasks else df
