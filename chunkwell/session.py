"""Session settings this package is tuned for, and shared-folder lookup."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster alike. Sizes of shuffles
#: are left to adaptive execution; Python workers get one BLAS thread because
#: Spark already runs one task per core.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`SETTINGS` to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    all tasks run in this one process, as in local tests, a fresh folder stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """The rows of a DataFrame, kept as a table in the shared folder.

    For rows that are costly to make and read more than once: they are made
    once, and a lost executor does not make them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
