"""Data model: rasters as tables of pixels or of binary tiles, and the settings of a run.

pixel : image_id string, y int, x int, c int, v int                      one sample per row, v in 0..255
tile  : image_id string, tile_row int, tile_col int, global_x int, global_y int, core_w int, core_h int, halo int,
        fmt string, data binary                                          row-major, channels interleaved
"""

from __future__ import annotations

from dataclasses import dataclass

CHANNELS = {"GRAY8": 1, "RGB8": 3, "RGBA8": 4}
BORDERS = ("zero", "clamp", "reflect")
PIXEL = "image_id string, y int, x int, c int, v int"
TILE = "image_id string, tile_row int, tile_col int, global_x int, global_y int, core_w int, core_h int, halo int, fmt string, data binary"


@dataclass(frozen=True)
class RasterInfo:
    """What is known of an image before its samples are read."""

    image_id: str
    width: int
    height: int
    fmt: str = "GRAY8"
    native_tile_w: int = 256
    native_tile_h: int = 256

    def __post_init__(self) -> None:
        if self.fmt not in CHANNELS:
            raise ValueError(f"unsupported pixel format {self.fmt!r}")
        if self.width <= 0 or self.height <= 0:
            raise ValueError("an image needs a positive width and height")

    @property
    def channels(self) -> int:
        return CHANNELS[self.fmt]


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run. threads and in_flight are accepted for compatibility; Spark schedules tasks itself."""

    tile_size: int = 512
    halo: int = 16
    border: str = "clamp"
    threads: int = 0
    in_flight: int = 16
    mode: str = "parallel"

    def __post_init__(self) -> None:
        if self.tile_size <= 0:
            raise ValueError("tile_size must be positive")
        if self.halo < 0:
            raise ValueError("halo must not be negative")
        if self.border not in BORDERS:
            raise ValueError(f"unknown border mode {self.border!r}")
        if self.mode not in ("parallel", "sequential", "both", "hetero", "hetero-bench"):
            raise ValueError(f"unknown mode {self.mode!r}")
