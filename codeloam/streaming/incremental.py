"""Analysis of files as they arrive: a stream of files(rev, path, oid, size, content) into the analysis cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..plans.scan import ANALYSIS, VERSION, _analyse


def analyse_stream(files: DataFrame, cache: str, checkpoint: str) -> StreamingQuery:
    """Analyse each micro-batch's new contents once and append them to the cache.

    Contents are keyed by oid and dialect; a batch that is repeated after a failure adds rows that the
    cache's reader drops as duplicates."""
    folder = f"{cache.rstrip('/')}/version={VERSION}"

    def add(batch: DataFrame, _: int) -> None:
        own = batch.withColumn("dialect", paths.dialect(F.col("path"))).where("dialect is not null").dropDuplicates(["oid", "dialect"])
        done = own.select("oid", "dialect", "size", "path", "content").mapInPandas(_analyse, ANALYSIS)
        done.where("size(warnings) = 0 and error is null").write.mode("append").parquet(folder)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
