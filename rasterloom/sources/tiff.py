"""TIFF files with 8-bit samples, tiled or in strips, classic or Big.

The header is read once on the driver; the samples are read by the tasks, each its own tiles and only the byte ranges
that these need, through pyarrow's file systems, so that an image of any size is read in parallel and in bounded memory.
Samples may be stored plain, deflated or as PackBits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from rasterloom.model import TILE, RasterInfo
from rasterloom.operators.grid import grid_size
from rasterloom.operators.tiles import tile_batch

#: Fixed values of the format: tags, and the sizes and struct letters of field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP = 256, 257, 258, 259, 262, 273, 277, 278
STRIP_COUNTS, PLANAR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, EXTRA_SAMPLES = 279, 284, 322, 323, 324, 325, 338
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773
BIG_FROM = 3 << 30


@dataclass(frozen=True)
class TiffLayout:
    """Where the samples lie: blocks of block_w x block_h in raster order."""

    width: int
    height: int
    channels: int
    tiled: bool
    block_w: int
    block_h: int
    compression: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    def info(self, image_id: str) -> RasterInfo:
        return RasterInfo(image_id, self.width, self.height, {1: "GRAY8", 3: "RGB8", 4: "RGBA8"}[self.channels], self.block_w, self.block_h)


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner)


def _create(path: str):
    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_output_stream(inner)


def read_layout(path: str) -> TiffLayout:
    with _open(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 8:
            raise ValueError(f"{path} is not a TIFF file")
        version = struct.unpack(order + "H", head[2:4])[0]
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = version == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        n_size, entry, inline = (8, 20, 8) if big else (2, 12, 4)
        n = struct.unpack(order + ("Q" if big else "H"), f.read_at(n_size, at))[0]
        block = f.read_at(n * entry, at + n_size)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            raw = block[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", raw[:4])
            count = struct.unpack(order + ("Q" if big else "I"), raw[4 : 4 + inline])[0]
            if kind not in FIELDS:
                continue
            letters = f"{order}{count}{FIELDS[kind]}"
            size = struct.calcsize(letters)
            value = raw[4 + inline :]
            if size > inline:
                value = f.read_at(size, struct.unpack(order + ("Q" if big else "I"), value)[0])
            tags[tag] = struct.unpack(letters, value[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    if not width or not height:
        raise ValueError("an image needs a positive width and height")
    if any(b != 8 for b in tags.get(BITS, (1,))):
        raise ValueError("only samples of 8 bits are supported")
    if channels not in (1, 3, 4):
        raise ValueError(f"{channels} samples per pixel are not supported")
    if one(PLANAR, 1) != 1 or one(COMPRESSION, NONE) not in (NONE, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError("only interleaved samples, plain, deflated or as PackBits, are supported")
    tiled = TILE_OFFSETS in tags
    size = (one(TILE_WIDTH, width), one(TILE_LENGTH, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    return TiffLayout(width, height, channels, tiled, *size, one(COMPRESSION, NONE), tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS])


def unpacked(data: bytes) -> bytes:
    """PackBits: a length byte below 128 copies, above 128 repeats."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def read_block(f, layout: TiffLayout, index: int) -> np.ndarray:
    across = -(-layout.width // layout.block_w)
    height = layout.block_h if layout.tiled else min(layout.block_h, layout.height - index // across * layout.block_h)
    data = f.read_at(layout.counts[index], layout.offsets[index])
    if layout.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif layout.compression == PACKBITS:
        data = unpacked(data)
    n = height * layout.block_w * layout.channels
    return np.frombuffer(data, np.uint8, n).reshape(height, layout.block_w, layout.channels)


def read_region(f, layout: TiffLayout, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A rectangle inside the image. Rows of plain strips are read as byte ranges; other blocks are decoded one by one."""
    if not layout.tiled and layout.compression == NONE:
        return read_rows(f, layout, x, y, w, h)
    out = np.zeros((h, w, layout.channels), np.uint8)
    across = -(-layout.width // layout.block_w)
    for row in range(y // layout.block_h, (y + h - 1) // layout.block_h + 1):
        for col in range(x // layout.block_w, (x + w - 1) // layout.block_w + 1):
            block = read_block(f, layout, row * across + col)
            top, left = row * layout.block_h, col * layout.block_w
            y0, y1 = max(y, top), min(y + h, top + block.shape[0])
            x0, x1 = max(x, left), min(x + w, left + block.shape[1])
            out[y0 - y : y1 - y, x0 - x : x1 - x] = block[y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def read_rows(f, layout: TiffLayout, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A rectangle of an image in plain strips: of each row only the bytes wanted. Rows that follow each other in the file
    are read at once if the rectangle is as wide as the image."""
    row_bytes, n = layout.width * layout.channels, w * layout.channels
    at = [layout.offsets[k // layout.block_h] + k % layout.block_h * row_bytes + x * layout.channels for k in range(y, y + h)]
    parts, k = [], 0
    while k < h:
        end = k + 1
        while end < h and n == row_bytes and at[end] == at[end - 1] + n:
            end += 1
        parts.append(f.read_at((end - k) * n, at[k]))
        k = end
    return np.frombuffer(b"".join(parts), np.uint8).reshape(h, w, layout.channels)


def read_tiff(spark: SparkSession, path: str, tile_size: int = 512, image_id: str | None = None) -> tuple[DataFrame, RasterInfo]:
    """The tiles of an image, without halo."""
    layout = read_layout(path)
    info = layout.info(image_id or path)
    columns, rows = grid_size(layout.width, layout.height, tile_size)
    shared = spark.sparkContext.broadcast(layout)  # the places of its blocks, as the file lists them

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        with _open(path) as f:
            for batch in batches:
                for place in batch.column(0).to_pylist():
                    row, col = divmod(place, columns)
                    x, y = col * tile_size, row * tile_size
                    w, h = min(tile_size, layout.width - x), min(tile_size, layout.height - y)
                    yield tile_batch([(info.image_id, row, col, x, y, w, h, 0, info.fmt, read_region(f, layout, x, y, w, h).tobytes())])

    # Tiles of one row of the grid share strips, so neighbouring ids go to one task.
    tasks = max(1, min(rows * columns, -(-rows * columns // 16)))
    return spark.range(0, rows * columns, 1, tasks).mapInArrow(read, TILE), info


def bands(tiles: DataFrame, info: RasterInfo) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, samples) of each row of the grid of tiles, from the top; absent samples are 0."""
    top, band = 0, None
    for row in tiles.orderBy("global_y", "global_x").toLocalIterator():
        if band is not None and row["global_y"] != top:
            yield top, band
            band = None
        if band is None:
            top, band = row["global_y"], np.zeros((row["core_h"], info.width, info.channels), np.uint8)
        core = np.frombuffer(row["data"], np.uint8).reshape(row["core_h"], row["core_w"], info.channels)
        band[: row["core_h"], row["global_x"] : row["global_x"] + row["core_w"]] = core
    if band is not None:
        yield top, band


def write_tiff(tiles: DataFrame, info: RasterInfo, path: str) -> None:
    """One file, plain, a row to a strip; Big beyond 3 GiB. The tiles must form a grid, without halo. They pass through
    the driver one band of tiles after the other, so memory is that of a band. The file is written from its beginning to
    its end, so it may lie in any store that pyarrow's file systems reach."""
    row_bytes = info.width * info.channels
    big = row_bytes * info.height > BIG_FROM
    word = "Q" if big else "I"
    kind, head = (16, 16) if big else (4, 8)
    tags = [
        (WIDTH, 4, [info.width]), (LENGTH, 4, [info.height]), (BITS, 3, [8] * info.channels), (COMPRESSION, 3, [NONE]),
        (PHOTOMETRIC, 3, [1 if info.channels == 1 else 2]), (STRIP_OFFSETS, kind, [head + row_bytes * y for y in range(info.height)]),
        (SAMPLES, 3, [info.channels]), (ROWS_PER_STRIP, 4, [1]), (STRIP_COUNTS, 4, [row_bytes] * info.height), (PLANAR, 3, [1]),
        *([(EXTRA_SAMPLES, 3, [2])] if info.channels == 4 else []),
    ]
    end = head + row_bytes * info.height
    with _create(path) as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, end) if big else struct.pack("<2sHI", b"II", 42, end))
        done = 0
        for top, band in bands(tiles, info):
            for _ in range(done, top):
                f.write(bytes(row_bytes))
            f.write(band.tobytes())
            done = top + len(band)
        for _ in range(done, info.height):
            f.write(bytes(row_bytes))
        values_at = end + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
        entries, values = b"", b""
        for tag, field, numbers in tags:
            data = struct.pack(f"<{len(numbers)}{FIELDS[field]}", *numbers)
            inline = 8 if big else 4
            if len(data) > inline:
                place = struct.pack(f"<{word}", values_at + len(values))
                values += data + b"\0" * (len(data) % 2)
            else:
                place = data.ljust(inline, b"\0")
            entries += struct.pack(f"<HH{word}", tag, field, len(numbers)) + place
        f.write(struct.pack("<Q" if big else "<H", len(tags)) + entries + struct.pack(f"<{word}", 0) + values)
