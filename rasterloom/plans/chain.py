"""Chains of steps: built in code or from a line of text, checked before anything runs, then run over pixels or tiles."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo, RunConfig
from rasterloom.operators import tiles as tile_ops
from rasterloom.operators.halo import check_halo
from rasterloom.operators.mosaic import check_bounds, mosaic, on_canvas
from rasterloom.operators.transforms import Blur, Crop, Identity, Origin, Resize, Rotate, Step, Tiles

#: name -> (step, the types of its arguments)
STEPS = {"identity": (Identity, ()), "blur": (Blur, (int,)), "crop": (Crop, (int,) * 4), "resize": (Resize, (float, float)), "rotate": (Rotate, (float,))}


@dataclass(frozen=True)
class Chain:
    steps: tuple[Step, ...] = field(default=())

    @classmethod
    def parse(cls, line: str) -> Chain:
        """`blur 4 | crop 0 0 100 100`: steps with their arguments, separated by bars; an empty line is the identity."""
        steps = []
        for part in filter(None, (p.split() for p in line.split("|"))):
            if part[0] not in STEPS:
                raise ValueError(f"unknown step {part[0]!r}")
            kind, types = STEPS[part[0]]
            if len(part) - 1 != len(types):
                raise ValueError(f"{part[0]} takes {len(types)} arguments, not {len(part) - 1}")
            steps.append(kind(*[t(x) for t, x in zip(types, part[1:], strict=True)]))
        return cls(tuple(steps or [Identity()]))

    @property
    def halo(self) -> int:
        return max([0, *(s.halo for s in self.steps)])

    @property
    def overlapping(self) -> bool:
        return any(isinstance(s, Resize) for s in self.steps)

    def output_size(self, width: int, height: int) -> tuple[int, int]:
        for s in self.steps:
            width, height = s.output_size(width, height)
        return width, height

    def check(self) -> None:
        """A blur needs a halo, which only the first step's tiles have."""
        for s in self.steps[1:]:
            if isinstance(s, Blur):
                check_halo(0, s.radius, "a blur after another step")

    def rewritten(self) -> Chain:
        """The same result by fewer steps: identities go, and neighbouring crops become one where that is exact."""
        found: list[Step] = []
        for s in self.steps:
            if type(s) is Identity:
                continue
            before = found[-1] if found else None
            if isinstance(s, Crop) and isinstance(before, Crop) and min(s.x0, s.y0) >= 0:
                width, height = before.x1 - before.x0, before.y1 - before.y0
                cut = Crop(before.x0 + s.x0, before.y0 + s.y0, before.x0 + min(s.x1, width), before.y0 + min(s.y1, height))
                if min(before.x0, before.y0) >= 0:
                    found[-1] = cut
                    continue
            found.append(s)
        # A step after an identity has no halo, so the identity in front of it stays.
        if type(self.steps[0]) is Identity and found and not isinstance(found[0], Crop):
            found.insert(0, Identity())
        return Chain(tuple(found or [Identity()]))


def effective_halo(chain: Chain, config: RunConfig) -> int:
    return max(config.halo, chain.halo)


def run_on_pixels(pixels: DataFrame, info: RasterInfo, chain: Chain, config: RunConfig) -> Tiles:
    """A chain in DataFrame operators alone."""
    chain.check()
    steps = chain.rewritten().steps
    tiles = steps[0].first(Origin(info, pixels, config.tile_size, effective_halo(chain, config), config.border))
    for s in steps[1:]:
        tiles = s.later(tiles)
    return tiles


def run_on_tiles(tiles: DataFrame, info: RasterInfo, chain: Chain, config: RunConfig, one_task: bool = False) -> DataFrame:
    """A chain over a table of tiles without halo: one exchange of strips if the first step reads a halo, then one pass.
    one_task: everything in one task after the other, for comparison."""
    chain.check()
    steps = chain.rewritten().steps
    halo = effective_halo(chain, config) if steps[0].halo else 0
    return tile_ops.run_tiles(tile_ops.with_halo(tiles, info, config.tile_size, halo, config.border, one_task), list(steps), info)


def canvas_of(chain: Chain, info: RasterInfo, canvas: str) -> RasterInfo:
    """The input's size, or (`exact`) the size that the steps add up to."""
    if canvas == "input":
        return info
    width, height = chain.output_size(info.width, info.height)
    return replace(info, width=max(1, width), height=max(1, height))


def covers_canvas(chain: Chain, canvas: str) -> bool:
    """Is every sample of the canvas in the chain's output, whatever the input lacks? A rotation computes each sample of
    the image, and steps that keep its size lose none."""
    kinds = [type(s) for s in chain.steps]
    return canvas == "input" and Rotate in kinds and all(k in (Identity, Blur, Rotate) for k in kinds)


def render(pixels: DataFrame, info: RasterInfo, chain: Chain, config: RunConfig | None = None, canvas: str = "input") -> DataFrame:
    """The chain's image as a pixel table, every sample of the canvas."""
    config = config or RunConfig()
    tiles = run_on_pixels(pixels, info, chain, config)
    target = canvas_of(chain, info, canvas)
    if covers_canvas(chain, canvas):  # no join with a grid of the canvas
        return mosaic(tiles).select(F.lit(target.image_id).alias("image_id"), "y", "x", "c", "v")
    check_bounds(tiles, target)
    return on_canvas(mosaic(tiles), target)


def render_tiles(tiles: DataFrame, info: RasterInfo, chain: Chain, config: RunConfig | None = None, canvas: str = "input") -> DataFrame:
    """The chain's image as a table of tiles that cover the canvas, from a table of tiles."""
    config = config or RunConfig()
    return tile_ops.canvas_tiles(run_on_tiles(tiles, info, chain, config), canvas_of(chain, info, canvas), config.tile_size)


def render_global(pixels: DataFrame, info: RasterInfo, chain: Chain, border: str = "clamp", canvas: str = "input") -> DataFrame:
    """The chain over the image as one tile: no seams, and every step, a later blur too, sees the whole image."""
    target = canvas_of(chain, info, canvas)
    for s in chain.steps:
        side = max(info.width, info.height)
        tiles = s.first(Origin(info, pixels, side, max(s.halo, RunConfig.halo), border))
        width, height = s.output_size(info.width, info.height)
        info = replace(info, width=max(1, width), height=max(1, height))
        pixels = mosaic(tiles).where((F.col("x") < info.width) & (F.col("y") < info.height))
    inside = (F.col("x") < target.width) & (F.col("y") < target.height)
    return on_canvas(pixels.where(inside), target)
