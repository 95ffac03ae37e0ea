"""Daily merge as a stream of snapshot files (inc_01, inc_05, inc_06, snk_04).

Each micro-batch is merged into the retained state by the batch build's own rules and writes only what
it touches (``sources.retained``). A batch that is replayed after a failure finds itself committed, or
writes its own folders anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from marquee.sources.retained import Retained


def merge_into(root: str, schema: str, stamp: Callable[[DataFrame], str], share: float = 0.5, **merge_args):
    """``foreachBatch`` function: merge one batch of listings into the state under ``root``.

    ``schema``: columns of the state. ``stamp`` gives the batch's time from its rows, so a replay uses
    the same one. ``share``: see ``Retained.compact``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        if batch.isEmpty():
            return
        state = Retained(spark, root, schema)
        listings = batch.select(*[c for c in batch.columns if c != "snapshot_at"])
        state.apply(batch_id, listings, stamp(batch), **merge_args)
        state.compact(share)

    return run


def start(stream: DataFrame, checkpoint: str, run) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
