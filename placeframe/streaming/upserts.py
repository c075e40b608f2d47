"""Structured Streaming over the same pure functions: observations upserted into a state table, and windowed price activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeframe.operators.state import upsert
from placeframe.operators.stats import newest_per_key
from placeframe.sources.files import read_or_empty
from placeframe.sources.sinks import swap_table


def upsert_stream(observations: DataFrame, state_path: str, state_schema, checkpoint: str, as_of: Column, order: str = "ts", key: str = "id") -> StreamingQuery:
    """Upsert each micro-batch into the state table, the newest observation of each key only.

    A batch that runs again after a failure writes the same state, so the sink is idempotent.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        state = read_or_empty(spark, state_path, state_schema)
        fresh = newest_per_key(batch, key, order).drop(order)
        merged = upsert(state, fresh, as_of, key)
        swap_table(merged.select([F.col(f.name).cast(f.dataType) for f in state.schema.fields]), state_path)

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_activity(changes: DataFrame, late: str = "1 day", width: str = "1 day", group: str = "district") -> DataFrame:
    """Price changes per group and window; changes later than ``late`` are left out, so that state stays bounded."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width), group).agg(F.count(F.lit(1)).alias("changes"), F.avg("price").alias("mean_price"))
