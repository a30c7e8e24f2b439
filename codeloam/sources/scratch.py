"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="codeloam-scan-"))
    path = f"{folder.rstrip('/')}/codeloam-scan-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN[path] = path
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder then stays behind
        pass


def keep(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
