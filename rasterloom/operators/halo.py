"""Tiles read with a ring of neighbouring samples, and what is done to that ring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.border import border_coordinate
from rasterloom.model import RasterInfo
from rasterloom.operators.grid import BOX, KEY, tile_grid


def check_halo(available: int, needed: int, name: str = "step") -> None:
    if available < needed:
        raise ValueError(f"{name} needs a halo of {needed} samples; its input tiles have {available}")


def read_tiles(pixels: DataFrame, info: RasterInfo, tile_size: int, halo: int, border: str) -> DataFrame:
    """(tile_row, tile_col, gx, gy, cw, ch, by, bx, c, v): every sample of every tile's buffer of core plus halo.

    The buffers' coordinates are generated and looked up by one equi-join, on the coordinates that the border mode maps
    them to; no range join. Coordinates that read zero get keys of their own, which match nothing, so they spread.
    """
    spark = pixels.sparkSession
    cells = tile_grid(spark, info, tile_size).select("*", F.explode(F.sequence(F.lit(0), F.col("ch") + 2 * halo - 1)).alias("by"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("cw") + 2 * halo - 1)).alias("bx"))
    cells = cells.select("*", F.explode(F.array(*[F.lit(k) for k in range(info.channels)])).alias("c"))
    y = border_coordinate(F.col("gy") + F.col("by") - halo, info.height, border)
    x = border_coordinate(F.col("gx") + F.col("bx") - halo, info.width, border)
    outside = y.isNull() | x.isNull()
    cells = cells.select("*", F.when(outside, -1 - F.col("by")).otherwise(y).alias("y"), F.when(outside, -1 - F.col("bx")).otherwise(x).alias("x"))
    found = cells.join(pixels.select("y", "x", "c", "v"), ["y", "x", "c"], "left")
    return found.select(*KEY, *BOX, "by", "bx", "c", F.coalesce("v", F.lit(0)).alias("v"))


def strip_halo(buffers: DataFrame, halo: int) -> DataFrame:
    """The cores alone: (tile_row, tile_col, gx, gy, cw, ch, ly, lx, c, v)."""
    y, x = F.col("by") - halo, F.col("bx") - halo
    return buffers.where((y >= 0) & (y < F.col("ch")) & (x >= 0) & (x < F.col("cw"))).select(*KEY, *BOX, y.alias("ly"), x.alias("lx"), "c", "v")


def fill_halo(buffers: DataFrame, halo: int, border: str) -> DataFrame:
    """Buffers whose halo is read again from the tile's own core."""
    core = strip_halo(buffers, halo).select(*KEY, F.col("ly").alias("sy"), F.col("lx").alias("sx"), "c", "v")
    y = border_coordinate(F.col("by") - halo, F.col("ch"), border)
    x = border_coordinate(F.col("bx") - halo, F.col("cw"), border)
    outside = y.isNull() | x.isNull()
    cells = buffers.select(*KEY, *BOX, "by", "bx", "c", F.when(outside, -1 - F.col("by")).otherwise(y).alias("sy"), F.when(outside, -1 - F.col("bx")).otherwise(x).alias("sx"))
    found = cells.join(core, [*KEY, "sy", "sx", "c"], "left")
    return found.select(*KEY, *BOX, "by", "bx", "c", F.coalesce("v", F.lit(0)).alias("v"))


def visualise_halo(buffers: DataFrame, info: RasterInfo, halo: int) -> DataFrame:
    """RGBA buffers that show cores as they are and halos tinted red."""
    parts = [F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"c{k}") for k in range(info.channels)]
    wide = buffers.groupBy(*KEY, *BOX, "by", "bx").agg(*parts)
    inside = F.col("by").between(halo, halo + F.col("ch") - 1) & F.col("bx").between(halo, halo + F.col("cw") - 1)
    third = F.expr("cast(c0 div 3 as int)")
    tinted = [F.least(F.lit(255), F.col("c0") + 80), third, third, F.lit(200)]
    plain = {1: ["c0", "c0", "c0", None], 3: ["c0", "c1", "c2", None], 4: ["c0", "c1", "c2", "c3"]}[info.channels]
    samples = [F.when(inside, F.lit(255) if p is None else F.col(p)).otherwise(t) for p, t in zip(plain, tinted, strict=True)]
    return wide.select(*KEY, *BOX, "by", "bx", F.posexplode(F.array(*samples)).alias("c", "v"))
