"""Colour spaces over the samples of one pixel. Single-precision steps are kept as FLOAT columns throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weights of red, green and blue in gray, in 1024ths.
GRAY_WEIGHTS = (306, 601, 117)


def by_pixel(pixels: DataFrame, channels: int) -> DataFrame:
    """(image_id, y, x, c0, c1, ...): the samples of a pixel side by side. One shuffle, with partial aggregation."""
    parts = [F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"c{k}") for k in range(channels)]
    return pixels.groupBy("image_id", "y", "x").agg(*parts)


def by_sample(wide: DataFrame, samples: list[Column]) -> DataFrame:
    """A pixel table of the given samples, in channel order."""
    one = F.posexplode(F.array(*[s.cast("int") for s in samples]))
    return wide.select("image_id", "y", "x", one.alias("c", "v"))


def _single(x: Column | float) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def _whole(x: Column) -> Column:
    """Truncation to an integer of a value that is not negative."""
    return F.floor(x).cast("int")


def gray_of(r: Column, g: Column, b: Column) -> Column:
    red, green, blue = GRAY_WEIGHTS
    return F.shiftright(r * red + g * green + b * blue, 10)


def rgb_to_gray(pixels: DataFrame) -> DataFrame:
    return by_sample(by_pixel(pixels, 3), [gray_of(F.col("c0"), F.col("c1"), F.col("c2"))])


def gray_to_rgb(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "y", "x", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("c"), "v")


def rgb_to_hsv(pixels: DataFrame) -> DataFrame:
    """Hue halved to 0..179, saturation and value in 0..255."""
    wide = by_pixel(pixels, 3).select("*", *[(_single(F.col(f"c{k}")) / _single(255)).cast("float").alias(n) for k, n in enumerate("rgb")])
    wide = wide.withColumn("top", F.greatest("r", "g", "b")).withColumn("span", (F.col("top") - F.least("r", "g", "b")).cast("float"))
    # Dividing two FLOAT columns goes through DOUBLE; casting its result back rounds as single precision does.
    over = lambda a: (a / F.col("span")).cast("float")
    sector = (
        F.when(F.col("top") == F.col("r"), over(F.col("g") - F.col("b")) % _single(6))
        .when(F.col("top") == F.col("g"), over(F.col("b") - F.col("r")) + _single(2))
        .otherwise(over(F.col("r") - F.col("g")) + _single(4))
    )
    hue = F.when(F.col("span") > _single(1e-6), _single(60) * sector).otherwise(_single(0))
    wide = wide.withColumn("hue", F.when(hue < 0, hue + _single(360)).otherwise(hue))
    saturation = F.when(F.col("top") > _single(1e-6), (F.col("span") / F.col("top")).cast("float")).otherwise(_single(0))
    samples = [_whole(F.col("hue") * _single(0.5)), _whole(saturation * _single(255) + _single(0.5)), _whole(F.col("top") * _single(255) + _single(0.5))]
    return by_sample(wide, samples)


def hsv_to_rgb(pixels: DataFrame) -> DataFrame:
    wide = by_pixel(pixels, 3)
    wide = wide.select("image_id", "y", "x", (_single(F.col("c0")) * _single(2)).alias("h"), *[(_single(F.col(f"c{k}")) / _single(255)).cast("float").alias(n) for k, n in ((1, "s"), (2, "value"))])
    wide = wide.withColumn("chroma", F.col("value") * F.col("s")).withColumn("turn", (F.col("h") / _single(60)).cast("float"))
    wide = wide.withColumn("second", F.col("chroma") * (_single(1) - F.abs(F.col("turn") % _single(2) - _single(1))))
    wide = wide.withColumn("rest", F.col("value") - F.col("chroma")).withColumn("sector", F.floor("turn").cast("int") % 6)
    chroma, second, none, sector = F.col("chroma"), F.col("second"), _single(0), F.col("sector")
    # Which of chroma, second and nothing red, green and blue hold in each sixth of the circle.
    red = F.when(sector == 0, chroma).when(sector == 1, second).when(sector == 2, none).when(sector == 3, none).when(sector == 4, second).otherwise(chroma)
    green = F.when(sector == 0, second).when(sector == 1, chroma).when(sector == 2, chroma).when(sector == 3, second).when(sector == 4, none).otherwise(none)
    blue = F.when(sector == 0, none).when(sector == 1, none).when(sector == 2, second).when(sector == 3, chroma).when(sector == 4, chroma).otherwise(second)
    samples = [_whole((held + F.col("rest")) * _single(255) + _single(0.5)) for held in (red, green, blue)]
    return by_sample(wide, samples)
