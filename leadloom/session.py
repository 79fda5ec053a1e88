"""Session settings and the shared folder for cut lineage and written tables."""

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.leadloom.shipped"


@functools.cache
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="leadloom-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, named by ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master, where nothing else
    is configured (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _test_dir()


def new_dir(spark: SparkSession, label: str) -> str:
    """Fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/leadloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A written table survives lost executors and is computed once however often
    it is read.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> DataFrame:
    """Send this package to the executors, once per application, so that their Python can import it."""
    context = df.sparkSession.sparkContext
    if not context.getLocalProperty(_SHIPPED):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "leadloom.zip")  # the driver serves it from there
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
        context.setLocalProperty(_SHIPPED, "true")
    return df
