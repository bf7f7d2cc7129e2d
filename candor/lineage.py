"""Cutting lineage in iterative operators so that a lost executor costs one round."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTENERS_MS = 2000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a temporary folder on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that nothing refers to any more.

    Spark removes them once Python and the driver's JVM have collected the plans they belong to, and a driver that has memory left does not
    collect.  The last plan is held by the event of its end until listeners have seen it, and by the scheduler until it has seen another
    job; if listeners lag behind, its files go with the next step.
    """
    gc.collect()
    sc = spark.sparkContext
    with suppress(Py4JJavaError):
        sc._jsc.parallelize([0], 1).count()
        sc._jsc.sc().listenerBus().waitUntilEmpty(LISTENERS_MS)
    sc._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    As long as the result is held, so are the shuffle files it came from; large tables are better :func:`written`.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df  # holds the plan
    release(spark)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the checkpoint directory, removed when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed files in the checkpoint folder: for tables that are read by column or more than once."""
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a :func:`written` table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows, written out, with numbers from 0 on and without gaps in ``column``."""
    raw = written(df.withColumn(column, F.monotonically_increasing_id()), name)
    part = F.shiftright(column, 33).cast("int")
    sizes = {r[0]: r[1] for r in raw.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()}
    first, before = [], 0
    for k in range(max(sizes, default=0) + 1):
        first.append(before)
        before += sizes.get(k, 0)
    begins = F.array(*[F.lit(x).cast("long") for x in first])
    return raw.withColumn(column, F.element_at(begins, part + 1) + F.col(column).bitwiseAND(F.lit((1 << 33) - 1)))
