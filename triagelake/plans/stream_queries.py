"""Streaming queries, drained over what is there, and the source connectors over fixtures."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.plans.registry import query
from triagelake.plans.tables import EMERGENCY, fold, table
from triagelake.store import shared_dir
from triagelake.streaming import triage as S

_SCORE = " + ".join(f"CASE WHEN contains({fold('tweet')}, '{w}') THEN {k} ELSE 0 END" for k, ws in X.URGENCY.values() for w in ws)


@query("stream_hourly_urgency", f"SELECT date_trunc('hour', created_at) AS window_start, count(*) AS messages, count(*) FILTER (({_SCORE}) > 0) AS urgent FROM {EMERGENCY} WHERE created_at IS NOT NULL GROUP BY 1")
def hourly(spark, d):
    """Hourly counts by a stream in complete mode: equal to the batch result."""
    schema = table(spark, d, EMERGENCY).schema
    reader = spark.readStream.schema(schema)
    path = f"{d}/{EMERGENCY}.parquet"
    if os.path.isfile(path):  # a stream reads a folder: of a single file, its folder by name
        reader, path = reader.option("pathGlobFilter", os.path.basename(path)), d
    m = S.triaged(reader.parquet(path))
    name = f"hourly_{uuid.uuid4().hex[:8]}"
    out = S.drain(S.window_counts(m, "created_at"), name, "complete", f"{shared_dir(spark)}/{name}")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "messages", "urgent")
