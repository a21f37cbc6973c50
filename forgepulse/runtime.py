"""What jobs need of the cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints, set on the context; one of this machine where a local master names none (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    held = context._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else named


def dealt_anew(name: str) -> Column:
    """The same values as a column of its own: a join on it deals out both sides anew, and only then may AQE split a hot key of the other side."""
    return F.greatest(name, name).alias(name)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any store that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, wherever the driver was started."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_own_package", None) is None and package.is_dir():
        context._own_package = f"{tempfile.mkdtemp(prefix='package-')}/{package.name}.zip"
        with zipfile.ZipFile(context._own_package, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(context._own_package)
