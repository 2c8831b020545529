"""Flagging variants that arrive as a stream, against a fixed relation of reads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import engine


def flag_stream(variants: DataFrame, reads: DataFrame, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> StreamingQuery:
    """Each micro-batch of ``variants`` is flagged by the batch plan and appended to ``out`` as Parquet.

    Variants don't depend on each other, so no state or watermark is needed.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        engine.flag(batch, reads, config).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return variants.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
