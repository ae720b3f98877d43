"""Incremental runs as streams: each run takes what is new, by checkpoint and by anti-join, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quire.runtime import materialize


def new_rows(spark: SparkSession, source: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int | None = None) -> None:
    """Hand every Parquet file that came since the last run to ``handle`` in batches, then stop. A run that fails is
    taken up again at the batch it was in, so ``handle`` must bear being called twice with a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = reader.parquet(source).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(handle).start()
    query.awaitTermination()


def keep_unseen(sink: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends rows whose key the sink doesn't hold yet; a batch repeated after a failure adds nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        new = batch.dropDuplicates([key])
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = new.join(spark.read.parquet(sink).select(key), key, "left_anti")
        materialize(new).write.mode("append").parquet(sink)

    return handle
