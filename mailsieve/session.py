"""What the library reads from the session."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is this machine, as in a test, a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mailsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="mailsieve-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
        _SHIPPED.add(context.applicationId)
    return spark
