"""Streams of messages: the row operators as they are, windowed counts, and first sightings of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.functions import text as T


def message_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def triaged(messages: DataFrame, text: str = "tweet") -> DataFrame:
    """Scores and flags; stateless, so the same for batches and streams."""
    t = T.low(F.col(text))
    return messages.withColumns({"score": T.weighted_score(T.ascii_fold(F.col(text)), X.URGENCY), "is_emergency": T.any_of(t, X.EMERGENCY)})


def window_counts(messages: DataFrame, at: str, late: str = "2 days", size: str = "1 hour") -> DataFrame:
    """Messages and urgent messages per window; rows later than `late` are dropped, rows without a time too."""
    m = messages.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = m.groupBy(F.window(at, size)).agg(F.count("*").alias("messages"), F.count_if(F.col("score") > 0).alias("urgent"))
    return out.select(F.col("window.start").alias("window_start"), "messages", "urgent")


def first_sightings(messages: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """The first row of every key; a key is forgotten once the watermark has passed it."""
    m = messages.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return m.dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now and give the result as a table, written beside the checkpoint.
    A batch has its own folder, so one that is tried again replaces itself; a complete result replaces the one before."""
    path = f"{checkpoint}-{name}"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=0")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
