"""Steps of a chain over pixel tables.

A step maps tiles to tiles without a halo. The first step of a chain reads the image itself, so it sees a halo and the
border mode; a later step sees its own tile only. `Tiles` carries both the boxes of the tiles (one row each) and their
samples, so that grids of new samples are generated from the boxes and not from the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.border import border_coordinate
from rasterloom.model import RasterInfo
from rasterloom.operators.grid import BOX, KEY, tile_grid, tiled
from rasterloom.operators.halo import check_halo


#: The halos that resizing and rotation ask for.
RESIZE_HALO, ROTATE_HALO = 1, 256


@dataclass(frozen=True)
class Tiles:
    info: RasterInfo  # of the original image, whatever the steps so far
    boxes: DataFrame  # tile_row, tile_col, gx, gy, cw, ch
    samples: DataFrame  # the same, and ly, lx, c, v
    overlapping: bool = False


@dataclass(frozen=True)
class Origin:
    """The image a first step reads."""

    info: RasterInfo
    pixels: DataFrame
    tile_size: int
    halo: int
    border: str

    def tiles(self) -> Tiles:
        return Tiles(self.info, tile_grid(self.pixels.sparkSession, self.info, self.tile_size), tiled(self.pixels, self.info, self.tile_size))


@dataclass(frozen=True)
class Step:
    """Base of the steps; also the identity."""

    name = "identity"

    @property
    def halo(self) -> int:
        return 0

    def first(self, origin: Origin) -> Tiles:
        return self.later(origin.tiles())

    def later(self, tiles: Tiles) -> Tiles:
        return tiles

    def output_size(self, width: int, height: int) -> tuple[int, int]:
        return width, height


@dataclass(frozen=True)
class Identity(Step):
    pass


@dataclass(frozen=True)
class Crop(Step):
    """Samples with x0 <= x < x1 and y0 <= y < y1, moved so that (x0, y0) becomes the origin."""

    x0: int
    y0: int
    x1: int
    y1: int
    name = "crop"

    def _cut(self, rows: DataFrame, extra: list[Column]) -> DataFrame:
        left, top = F.greatest("gx", F.lit(self.x0)), F.greatest("gy", F.lit(self.y0))
        right, bottom = F.least(F.col("gx") + F.col("cw"), F.lit(self.x1)), F.least(F.col("gy") + F.col("ch"), F.lit(self.y1))
        box = [(left - self.x0).alias("gx"), (top - self.y0).alias("gy"), (right - left).alias("cw"), (bottom - top).alias("ch")]
        return rows.where((left < right) & (top < bottom)).select(*KEY, *box, *extra)

    def later(self, tiles: Tiles) -> Tiles:
        x, y = F.col("gx") + F.col("lx"), F.col("gy") + F.col("ly")
        inside = tiles.samples.where((x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1))
        local = [(y - F.greatest("gy", F.lit(self.y0))).alias("ly"), (x - F.greatest("gx", F.lit(self.x0))).alias("lx"), F.col("c"), F.col("v")]
        return replace(tiles, boxes=self._cut(tiles.boxes, []), samples=self._cut(inside, local))

    def first(self, origin: Origin) -> Tiles:
        # The filter on plain x and y reaches the scan of the image.
        x, y = F.col("x"), F.col("y")
        inside = origin.pixels.where((x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1))
        return self.later(replace(origin, pixels=inside).tiles())

    def output_size(self, width: int, height: int) -> tuple[int, int]:
        return max(0, self.x1 - self.x0), max(0, self.y1 - self.y0)


@dataclass(frozen=True)
class Blur(Step):
    """Separable box blur; each pass rounds to whole samples, halves up."""

    radius: int
    name = "blur"

    def __post_init__(self) -> None:
        if self.radius < 0:
            raise ValueError("a blur radius must not be negative")

    @property
    def halo(self) -> int:
        return self.radius

    def _pass(self, pixels: DataFrame, along: str, across: str, n: int, border: str) -> DataFrame:
        """Window sums along one axis, over rows padded as the border mode says."""
        r = self.radius
        spark = pixels.sparkSession
        if border == "zero":
            padded = pixels.withColumn("p", F.col(along))  # a frame cut off at the edge adds nothing, as zeros would
        else:
            # Only coordinates near the edges are read more than once: their copies come from a table of 2 r rows.
            ring = spark.range(-r, r).select(F.when(F.col("id") < 0, F.col("id")).otherwise(F.col("id") + n).cast("int").alias("p"))
            ring = ring.select("p", border_coordinate(F.col("p"), n, border).alias(along))
            # The ring's size follows from the step alone, so it may be broadcast.
            copies = pixels.join(F.broadcast(ring), along)
            padded = pixels.withColumn("p", F.col(along)).unionByName(copies)
        frame = Window.partitionBy(across, "c").orderBy("p").rowsBetween(-r, r)
        count = 2 * r + 1
        summed = padded.select("c", across, "p", F.floor((F.sum("v").over(frame) + count // 2) / count).cast("int").alias("v"))
        return summed.where((F.col("p") >= 0) & (F.col("p") < n)).select(F.col("p").alias(along), across, "c", "v")

    def first(self, origin: Origin) -> Tiles:
        check_halo(origin.halo, self.radius, "blur")
        if self.radius == 0:
            return origin.tiles()
        info = origin.info
        # The first pass also blurs the rows of the halo; outside the image these are border copies of image rows, so
        # padding the result is the same as blurring padded rows.
        across = self._pass(origin.pixels.select("y", "x", "c", "v"), "x", "y", info.width, origin.border)
        down = self._pass(across, "y", "x", info.height, origin.border)
        return replace(origin, pixels=down).tiles()

    def later(self, tiles: Tiles) -> Tiles:
        check_halo(0, self.radius, "blur")
        return tiles


@dataclass(frozen=True)
class Resample(Step):
    """Steps that compute each new sample from four old ones."""

    def new_boxes(self, boxes: DataFrame) -> DataFrame:
        """boxes with ngx, ngy, ncw, nch."""
        raise NotImplementedError

    def source(self, info: RasterInfo) -> tuple[Column, Column]:
        """(x, y) in the image where the new sample (ngx + ox, ngy + oy) reads."""
        raise NotImplementedError

    def black(self, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
        return F.lit(False)

    def _sampled(self, boxes: DataFrame, info: RasterInfo, halo: int, source: DataFrame, border: str | None) -> DataFrame:
        cells = self.new_boxes(boxes).where("ncw > 0 and nch > 0")
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("nch") - 1)).alias("oy"))
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("ncw") - 1)).alias("ox"))
        x, y = self.source(info)
        cells = cells.select("*", (x - (F.col("gx").cast("double") - F.lit(float(halo)))).alias("bx"), (y - (F.col("gy").cast("double") - F.lit(float(halo)))).alias("by"))
        bw, bh = F.col("cw") + 2 * halo, F.col("ch") + 2 * halo
        held = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), (n - 1).cast("double"))
        cells = cells.select("*", self.black(F.col("bx"), F.col("by"), bw, bh).alias("black"), held(F.col("bx"), bw).alias("hx"), held(F.col("by"), bh).alias("hy"))
        cells = cells.select("*", F.floor("hx").cast("int").alias("left"), F.floor("hy").cast("int").alias("top"))
        cells = cells.select("*", (F.col("hx") - F.col("left")).alias("fx"), (F.col("hy") - F.col("top")).alias("fy"), F.least(F.col("left") + 1, bw - 1).alias("right"), F.least(F.col("top") + 1, bh - 1).alias("bottom"))
        corner = lambda k, sx, sy: F.struct(F.lit(k).alias("k"), F.col(sx).alias("sx"), F.col(sy).alias("sy"))
        corners = F.array(corner(0, "left", "top"), corner(1, "right", "top"), corner(2, "left", "bottom"), corner(3, "right", "bottom"))
        new = ["tile_row", "tile_col", "ngx", "ngy", "ncw", "nch", "oy", "ox"]
        wanted = cells.select(*new, "gx", "gy", "fx", "fy", "black", F.explode(corners).alias("s")).select("*", "s.k", "s.sx", "s.sy").drop("s")
        if border is None:  # inside the tile
            keys, sx, sy = [*KEY, "sy", "sx"], F.col("sx"), F.col("sy")
        else:
            keys = ["sy", "sx"]
            sx = border_coordinate(F.col("gx") + F.col("sx") - halo, info.width, border)
            sy = border_coordinate(F.col("gy") + F.col("sy") - halo, info.height, border)
        # What reads zero gets a key that matches nothing, a different one for each sample.
        none = F.col("black") | sx.isNull() | sy.isNull()
        wanted = wanted.select(*new, "fx", "fy", "k", F.when(none, -1 - F.col("ox")).otherwise(sx).alias("sx"), F.when(none, -1 - F.col("oy")).otherwise(sy).alias("sy"))
        # A pixel's samples travel side by side; one lookup of all four corners and one aggregation, not four joins.
        if info.channels == 1:
            rows = source.select(*keys, F.col("v").alias("v0"))
        else:
            rows = source.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"v{c}") for c in range(info.channels)])
        found = wanted.join(rows, keys, "left")
        corner = lambda k, c: F.coalesce(F.max(F.when(F.col("k") == k, F.col(f"v{c}"))), F.lit(0)).cast("double").alias(f"p{k}_{c}")
        one = found.groupBy(*new).agg(F.max("fx").alias("fx"), F.max("fy").alias("fy"), *[corner(k, c) for k in range(4) for c in range(info.channels)])
        gx, gy = F.lit(1.0) - F.col("fx"), F.lit(1.0) - F.col("fy")

        def value(c: int) -> Column:
            p = [F.col(f"p{k}_{c}") for k in range(4)]
            blend = gy * (gx * p[0] + F.col("fx") * p[1]) + F.col("fy") * (gx * p[2] + F.col("fx") * p[3])
            return F.floor(F.least(F.greatest(blend, F.lit(0.0)), F.lit(255.0))).cast("int")

        named = [F.col(f"n{k}").alias(k) for k in BOX]
        samples = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in range(info.channels)]))
        return one.select(*KEY, *named, F.col("oy").alias("ly"), F.col("ox").alias("lx"), samples.alias("s")).select(*KEY, *BOX, "ly", "lx", "s.c", "s.v")

    def _boxes(self, boxes: DataFrame) -> DataFrame:
        return self.new_boxes(boxes).where("ncw > 0 and nch > 0").select(*KEY, *[F.col(f"n{k}").alias(k) for k in BOX])

    def first(self, origin: Origin) -> Tiles:
        boxes = tile_grid(origin.pixels.sparkSession, origin.info, origin.tile_size)
        source = origin.pixels.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "c", "v")
        return Tiles(origin.info, self._boxes(boxes), self._sampled(boxes, origin.info, origin.halo, source, origin.border), self.overlaps)

    def later(self, tiles: Tiles) -> Tiles:
        source = tiles.samples.select(*KEY, F.col("ly").alias("sy"), F.col("lx").alias("sx"), "c", "v")
        return Tiles(tiles.info, self._boxes(tiles.boxes), self._sampled(tiles.boxes, tiles.info, 0, source, None), tiles.overlapping or self.overlaps)

    overlaps = False


@dataclass(frozen=True)
class Resize(Resample):
    """Bilinear resize by two scales, which are single precision, as are the corners of new tiles."""

    sx: float
    sy: float
    name = "resize"
    overlaps = True

    def __post_init__(self) -> None:
        if not (self.sx >= 0 and self.sy >= 0):
            raise ValueError("a scale must not be negative")

    @property
    def halo(self) -> int:
        return RESIZE_HALO

    def new_boxes(self, boxes: DataFrame) -> DataFrame:
        for axis, size, scale in (("gx", "cw", self.sx), ("gy", "ch", self.sy)):
            single = F.lit(float(np.float32(scale))).cast("float")
            boxes = boxes.withColumn(f"n{axis}", F.floor(F.col(axis).cast("float") * single).cast("int"))
            boxes = boxes.withColumn(f"n{size}", F.ceil((F.col(axis) + F.col(size)).cast("float") * single).cast("int") - F.col(f"n{axis}"))
        return boxes

    def source(self, info: RasterInfo) -> tuple[Column, Column]:
        inverse = [1.0 / float(np.float32(s)) if s else 0.0 for s in (self.sx, self.sy)]
        place = lambda corner, o, k: ((F.col(corner) + F.col(o)).cast("double") + F.lit(0.5)) * F.lit(inverse[k]) - F.lit(0.5)
        return place("ngx", "ox", 0), place("ngy", "oy", 1)

    def output_size(self, width: int, height: int) -> tuple[int, int]:
        size = lambda n, s: max(1, math.floor(float(np.float32(n) * np.float32(s)) + 0.5))
        return size(width, self.sx), size(height, self.sy)


@dataclass(frozen=True)
class Rotate(Resample):
    """Bilinear rotation about the centre of the original image, by degrees in single precision. What would read beyond a
    tile's buffer is black. As y points down, positive angles turn clockwise on a screen."""

    degrees: float
    name = "rotate"

    @property
    def halo(self) -> int:
        return ROTATE_HALO

    @property
    def turn(self) -> tuple[float, float]:
        angle = float(np.float32(self.degrees)) * math.pi / 180.0
        return math.cos(angle), math.sin(angle)

    def new_boxes(self, boxes: DataFrame) -> DataFrame:
        return boxes.select("*", *[F.col(k).alias(f"n{k}") for k in BOX])

    def source(self, info: RasterInfo) -> tuple[Column, Column]:
        cos, sin = (F.lit(t) for t in self.turn)
        mid_x, mid_y = F.lit((info.width - 1.0) * 0.5), F.lit((info.height - 1.0) * 0.5)
        dx = (F.col("gx").cast("double") + F.col("ox").cast("double")) - mid_x
        dy = (F.col("gy").cast("double") + F.col("oy").cast("double")) - mid_y
        return mid_x + (cos * dx + sin * dy), mid_y + (-sin * dx + cos * dy)

    def black(self, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
        return (bx < 0) | (bx >= bw - 1) | (by < 0) | (by >= bh - 1)
