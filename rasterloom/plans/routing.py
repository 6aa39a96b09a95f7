"""Which device a tile would go to, by estimated transfer and compute times, and how rates are learned from timings.
Routing labels tiles; it never changes their samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.chain import Chain


#: The reasons a tile is routed by, in the order in which their rules apply.
NO_GPU = "No GPU available"
CPU_STEP = "CPU preferred for identity/crop"
SMALL_TILE = "Tile too small for GPU"
TRANSFER = "PCIe transfer dominates"
FULL_QUEUE = "GPU queue full"
HEAVY = "Compute-heavy transform"


@dataclass(frozen=True)
class SchedulerConfig:
    """The model's assumed rates and thresholds, none of them measured."""

    gpu_available: bool = True
    min_gpu_tile_pixels: int = 1
    bytes_per_sec: float = 8.0e9
    gpu_mpix_per_sec: float = 1000.0
    cpu_mpix_per_sec: float = 100.0
    gpu_derate: float = 0.3
    spill_occupancy: float = 0.99


def classify(chain: Chain) -> str:
    return "GPU_PREFERRED" if chain.halo > 0 else "CPU_PREFERRED"


def transfer_time(tile_bytes: Column, config: SchedulerConfig) -> Column:
    return (tile_bytes * 2).cast("double") / F.lit(config.bytes_per_sec)


def kernel_time(pixels: Column, preference: str, config: SchedulerConfig) -> Column:
    rate = config.gpu_mpix_per_sec * config.gpu_derate if preference == "GPU_PREFERRED" else config.cpu_mpix_per_sec
    return pixels.cast("double") / F.lit(rate * 1e6)


def held_to_one(x: Column) -> Column:
    """An occupancy, held between 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def route_tiles(tiles: DataFrame, chain: Chain, config: SchedulerConfig | None = None, occupancy: Column | float = 0.0) -> DataFrame:
    """tiles (tile_row, tile_col, cw, ch, halo, channels) with device and reason; the first rule that applies decides."""
    config = config or SchedulerConfig()
    preference = classify(chain)
    pixels = F.col("cw") * F.col("ch")
    buffer = (F.col("cw") + 2 * F.col("halo")) * (F.col("ch") + 2 * F.col("halo")) * F.col("channels")
    ratio = kernel_time(pixels, preference, config) / (transfer_time(buffer, config) + F.lit(1e-12))
    full = held_to_one(F.lit(occupancy) if isinstance(occupancy, float) else occupancy)
    reason = (
        F.when(F.lit(not config.gpu_available), NO_GPU)
        .when(F.lit(preference == "CPU_PREFERRED"), CPU_STEP)
        .when(pixels < config.min_gpu_tile_pixels, SMALL_TILE)
        .when(ratio < 1.0, TRANSFER)
        .when(full >= config.spill_occupancy, FULL_QUEUE)
        .otherwise(HEAVY)
    )
    return tiles.withColumn("reason", reason).withColumn("device", F.when(F.col("reason") == HEAVY, "GPU").otherwise("CPU"))


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("device", "reason").agg(F.count(F.lit(1)).alias("n_tiles"))


#: The rates in megapixels per second that devices begin with.
START_RATES = {"GPU": SchedulerConfig.gpu_mpix_per_sec, "CPU": SchedulerConfig.cpu_mpix_per_sec}


def learned_rate(timings: DataFrame, keys: list[str], order: str, start: float | dict[str, float], keep: float = 0.9) -> DataFrame:
    """A rate per key that each timing (`seconds`, `pixels`) moves towards its own: keep of the old, the rest of the new.

    start: where rates begin, one for all keys or one for each value of the first key; keys without one are left out.

    Timings that are not positive are ignored. A closed form, so that no list is gathered per key: with n timings left
    after a row, the row weighs (1 - keep) * keep ** n. Rows whose weight underflows add nothing.
    """
    from pyspark.sql import Window

    used = timings.where("seconds > 0 and pixels > 0")
    left = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())) - 1
    rate = F.col("pixels").cast("double") / (F.col("seconds") * F.lit(1e6))
    weighed = used.select(*keys, rate.alias("rate"), left.alias("left"))
    added = F.sum(F.lit(1 - keep) * F.pow(F.lit(keep), F.col("left")) * F.col("rate"))
    begin = F.lit(start) if isinstance(start, float) else F.try_element_at(F.create_map(*[F.lit(x) for pair in start.items() for x in pair]), F.col(keys[0]))
    found = weighed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), added.alias("added"))
    return found.withColumn("start", begin).where("start is not null").select(*keys, "n", (F.col("start") * F.pow(F.lit(keep), F.col("n")) + F.col("added")).alias("rate"))


def scheduler_stats(log: DataFrame) -> DataFrame:
    """(device, n_tiles, rate) of a log (seq, device, seconds, pixels, reset): a reset sets the counts of tiles to nothing and
    leaves the rates, so tiles count from after the last one, and rates follow all timings."""
    last = log.agg(F.max(F.when(F.col("reset"), F.col("seq")))).first()[0]
    since = F.lit(True) if last is None else F.col("seq") > last
    counts = log.where(~F.col("reset")).groupBy("device").agg(F.count_if(since).alias("n_tiles"))
    rates = learned_rate(log.where(~F.col("reset")), ["device"], "seq", START_RATES).select("device", "rate")
    begin = F.create_map(*[F.lit(x) for pair in START_RATES.items() for x in pair])
    return counts.join(rates, "device", "left").select("device", "n_tiles", F.coalesce("rate", F.try_element_at(begin, F.col("device"))).alias("rate"))
