"""The append-only log as a stream: windows, additive statistics by batch, and a stop rule with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import token_stats
from quern.session import ship
from quern.streaming.stop import MERGED, RANGE_BITS, BoxedStops, merged


def tail(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of an append-only log; ``kind`` json or parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def windowed_routes(tokens: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean loss by event-time window and route; ``tokens`` has ts, route, final_loss."""
    grouped = tokens.withWatermark("ts", late).groupBy(F.window("ts", width), "route")
    return grouped.agg(
        F.count("*").alias("n"),
        F.avg("final_loss").alias("mean_loss"),
    ).select(F.col("window.start").alias("start"), "route", "n", "mean_loss")


#: The store that keeps state on disk with a changelog; stateful processors need it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def boxed_stops(tokens: DataFrame) -> DataFrame:
    """Per sequence, as its pieces arrive in order, the count so far and the piece in which its first box with content closed.

    ``tokens`` is a stream of seq_id, pos and piece; the session's state store must be ``ROCKS``.
    Neighbouring pieces are merged and plain text is left out before anything is shuffled.
    """
    ship(tokens.sparkSession)
    runs = tokens.select("seq_id", "pos", "piece").mapInArrow(merged, MERGED)
    return runs.withColumn("range", F.shiftright("seq_id", RANGE_BITS)).groupBy("range").transformWithStateInPandas(
        statefulProcessor=BoxedStops(),
        outputStructType="seq_id long, tokens long, stop_at long",
        outputMode="Update",
        timeMode="None",
    )


def run_available(stream: DataFrame, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Process what has arrived, each batch into a folder of its own number.

    A batch that is sent again after a failure replaces its folder, so ``target`` holds each row once.
    """

    def put(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def rolled_up(spark: SparkSession, target: str, *keys: str) -> DataFrame:
    """Token statistics of all batches of :func:`run_available` whose ``change`` is ``token_stats.group_sums`` by ``keys``."""
    return token_stats.stats_of(spark.read.parquet(target), *keys)
