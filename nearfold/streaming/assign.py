"""Nearest clusters for samples that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfold.operators.nearest import Centres, nearest_centres


def assign_stream(samples: DataFrame, centres: Centres, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Write (id, neighbours) for every new sample; stateless, so it needs no watermark."""
    near = nearest_centres(samples, centres, k)
    return (
        near.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
