"""What the operators of this subpackage share: table reading, checkpoints, worker set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: An Arrow batch handed to Python holds at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(df: DataFrame) -> SparkSession:
    """Bound the Arrow batches, unless the session has bounds of its own, and ship this package to the Python workers."""
    spark = df.sparkSession
    own = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    ship(spark.sparkContext)
    return spark


def ship(sc: SparkContext) -> None:
    """Send the package's modules to the executors, once an application: they need no copy of the repository."""
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="tidemark-modules-")  # the driver serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/tidemark-modules.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(os.path.join(REPO, "tidemark")):
            for name in files:
                if name.endswith((".py", ".txt")):
                    z.write(os.path.join(root, name), os.path.relpath(os.path.join(root, name), REPO))
    sc.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what executors and driver share; where none is named, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def word_count(text: Column) -> Column:
    """Number of maximal runs outside space and \\x09-\\x0D; 0 for null. One pass over the bytes, no regular expression."""
    one_space = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(one_space, " "), lambda w: F.length(w) > 0)), F.lit(0)).cast("long")


def fraction(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
