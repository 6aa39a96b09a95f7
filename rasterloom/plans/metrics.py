"""Counters and throughput of a run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "mode string, tiles_read long, tiles_processed long, tiles_skipped long, tiles_written long, elapsed_sec double, mpix_per_sec double"


def tile_stats(grid: DataFrame, written: DataFrame) -> DataFrame:
    """One row: tiles_read, tiles_processed, tiles_skipped, tiles_written, from the grid and the boxes that came out."""
    done = written.select("tile_row", "tile_col", F.lit(1).alias("done"))
    joined = grid.select("tile_row", "tile_col").join(done, ["tile_row", "tile_col"], "left")
    kept = F.count("done")
    return joined.agg(F.count(F.lit(1)).alias("tiles_read"), kept.alias("tiles_processed"), (F.count(F.lit(1)) - kept).alias("tiles_skipped"), kept.alias("tiles_written"))


def throughput(width: Column, height: Column, seconds: Column) -> Column:
    """Megapixels per second; 0 if no time has passed."""
    return F.when(seconds > 0, width.cast("double") * height / F.lit(1e6) / seconds).otherwise(F.lit(0.0))


def speedup(runs: DataFrame, threads: int) -> DataFrame:
    """(sequential_sec, parallel_sec, speedup, efficiency) of a table (mode, elapsed_sec)."""
    one = runs.agg(*[F.max(F.when(F.col("mode") == m, F.col("elapsed_sec"))).alias(f"{m}_sec") for m in ("sequential", "parallel")])
    gain = F.when(F.col("parallel_sec") > 0, F.col("sequential_sec") / F.col("parallel_sec")).otherwise(F.lit(0.0))
    return one.select("*", gain.alias("speedup"), (gain / F.lit(threads) * 100).alias("efficiency"))


def timed(spark: SparkSession, mode: str, megapixels: float, counters: tuple[int, int, int, int], work: Callable[[], None]) -> DataFrame:
    """Run work and return its stats row."""
    began = time.monotonic()
    work()
    seconds = time.monotonic() - began
    return spark.createDataFrame([(mode, *counters, seconds, megapixels / seconds if seconds > 0 else 0.0)], STATS)
