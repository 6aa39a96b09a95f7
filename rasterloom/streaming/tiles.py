"""A folder of tiles as a stream, and rates learned from a stream of timings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.model import TILE, RasterInfo
from rasterloom.operators.tiles import run_tiles
from rasterloom.plans.chain import Chain

TIMING = "device string, seq long, seconds double, pixels long"


def stream_tiles(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of the tile schema, as they arrive."""
    return spark.readStream.schema(TILE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_chain(tiles: DataFrame, chain: Chain, info: RasterInfo) -> DataFrame:
    """A chain over arriving tiles that carry the halo they need; no state."""
    chain.check()
    return run_tiles(tiles, list(chain.rewritten().steps), info)


def stream_rates(timings: DataFrame, start: dict[str, float], keep: float = 0.9) -> DataFrame:
    """(device, n, rate) after each batch of timings: the rate moves a part of the way to each timing's own."""

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, rate = state.get if state.exists else (0, start.get(key[0], 100.0))
        rows = pd.concat(list(frames)).sort_values("seq")
        for seconds, pixels in zip(rows["seconds"], rows["pixels"], strict=True):
            if seconds > 0 and pixels > 0:
                n, rate = n + 1, keep * rate + (1 - keep) * (pixels / (seconds * 1e6))
        state.update((n, rate))
        yield pd.DataFrame({"device": [key[0]], "n": [n], "rate": [rate]})

    return timings.groupBy("device").applyInPandasWithState(update, "device string, n long, rate double", "n long, rate double", "update", GroupStateTimeout.NoTimeout)
