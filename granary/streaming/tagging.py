"""Incremental tagging: new records in, tagged records appended, each id once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def start(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, tag: Callable[[DataFrame], DataFrame], files: int = 8) -> StreamingQuery:
    """Tags new Parquet files of ``source`` as they come and appends to ``out``.

    A batch's ids that ``out`` already has are left out, so a batch that is run again after a
    failure adds nothing twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["id"])
        try:
            done = rows.sparkSession.read.parquet(out).select("id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            rows = rows.join(done, "id", "left_anti")
        tag(rows).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
