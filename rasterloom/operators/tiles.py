"""Tables of binary tiles: made from pixels, given their halos, run through a chain, turned back into pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.model import PIXEL, TILE, RasterInfo
from rasterloom.operators import kernels
from rasterloom.operators.grid import grid_size, tiled
from rasterloom.operators.kernels import TileArray
from rasterloom.operators.transforms import Step

_NAMES = [f.split()[0] for f in TILE.split(", ")]
_KINDS = [{"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in TILE.split(", ")]


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def tile_rows(batch: pa.RecordBatch, channels: int) -> Iterator[tuple[str, int, int, TileArray, str]]:
    """(image_id, tile_row, tile_col, tile, fmt) of each row of a batch of the tile schema."""
    columns = [batch.column(n).to_pylist() for n in _NAMES[:-1]]
    for image_id, row, col, gx, gy, cw, ch, halo, fmt, data in zip(*columns, batch.column("data"), strict=True):
        array = np.frombuffer(data.as_buffer(), np.uint8).reshape(ch + 2 * halo, cw + 2 * halo, channels)
        yield image_id, row, col, TileArray(gx, gy, cw, ch, halo, array), fmt


def tiles_from_pixels(pixels: DataFrame, info: RasterInfo, tile_size: int) -> DataFrame:
    """Tiles without halo. Every pixel moves once, to its tile; absent samples are 0."""

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[0]
        array = np.zeros((one["ch"], one["cw"], info.channels), np.uint8)
        array[frame["ly"].to_numpy(), frame["lx"].to_numpy(), frame["c"].to_numpy()] = frame["v"].to_numpy()
        values = [info.image_id, one["tile_row"], one["tile_col"], one["gx"], one["gy"], one["cw"], one["ch"], 0, info.fmt, array.tobytes()]
        return pd.DataFrame({n: [v] for n, v in zip(_NAMES, values, strict=True)})

    return tiled(pixels, info, tile_size).groupBy("tile_row", "tile_col").applyInPandas(assemble, TILE)


def with_halo(tiles: DataFrame, info: RasterInfo, tile_size: int, halo: int, border: str, one_task: bool = False) -> DataFrame:
    """Tiles of the whole image with their halos. Each tile sends its neighbours only the strips that they lack, so a
    shuffle moves the image once plus the strips."""
    if halo == 0:
        return tiles
    columns, rows = grid_size(info.width, info.height, tile_size)
    reach = -(-halo // tile_size)
    names, kinds = ["tile_row", "tile_col", "y", "x", "h", "w", "piece"], [pa.int32()] * 6 + [pa.binary()]

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, col, tile, _ in tile_rows(batch, info.channels):
                out = []
                for r in range(max(0, row - reach), min(rows, row + reach + 1)):
                    for c in range(max(0, col - reach), min(columns, col + reach + 1)):
                        top, left = max(tile.gy, r * tile_size - halo), max(tile.gx, c * tile_size - halo)
                        bottom = min(tile.gy + tile.ch, min((r + 1) * tile_size, info.height) + halo)
                        right = min(tile.gx + tile.cw, min((c + 1) * tile_size, info.width) + halo)
                        if top < bottom and left < right:
                            part = tile.core()[top - tile.gy : bottom - tile.gy, left - tile.gx : right - tile.gx]
                            out.append((r, c, top, left, bottom - top, right - left, part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        row, col = int(frame["tile_row"].iloc[0]), int(frame["tile_col"].iloc[0])
        gx, gy = col * tile_size, row * tile_size
        cw, ch = min(tile_size, info.width - gx), min(tile_size, info.height - gy)
        buffer = np.zeros((ch + 2 * halo, cw + 2 * halo, info.channels), np.uint8)
        for y, x, h, w, piece in zip(*(frame[n] for n in names[2:]), strict=True):
            at_y, at_x = y - gy + halo, x - gx + halo
            buffer[at_y : at_y + h, at_x : at_x + w] = np.frombuffer(piece, np.uint8).reshape(h, w, info.channels)
        buffer = kernels.fill_border(buffer, gx, gy, halo, info, border)
        values = [info.image_id, row, col, gx, gy, cw, ch, halo, info.fmt, buffer.tobytes()]
        return pd.DataFrame({n: [v] for n, v in zip(_NAMES, values, strict=True)})

    sent = tiles.mapInArrow(strips, "tile_row int, tile_col int, y int, x int, h int, w int, piece binary")
    return dealt(sent, ["tile_row", "tile_col"], one_task).groupBy("tile_row", "tile_col").applyInPandas(join, TILE)


def dealt(rows: DataFrame, keys: list[str], one_task: bool) -> DataFrame:
    """rows by their keys; in one task, if all is to run in sequence."""
    return rows.coalesce(1).repartition(1, *keys) if one_task else rows


def run_tiles(tiles: DataFrame, steps: list[Step], info: RasterInfo) -> DataFrame:
    """Each tile through all steps in one pass, without a shuffle. Empty tiles go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, row, col, tile, fmt in tile_rows(batch, info.channels):
                out = kernels.apply_chain(steps, tile, info)
                if not out.empty:
                    yield tile_batch([(image_id, row, col, out.gx, out.gy, out.cw, out.ch, 0, fmt, np.ascontiguousarray(out.data).tobytes())])

    return tiles.mapInArrow(run, TILE)


def pixels_from_tiles(tiles: DataFrame, info: RasterInfo) -> DataFrame:
    """The cores' samples as a pixel table."""
    kinds = [pa.string(), *[pa.int32()] * 4]
    names = ["image_id", "y", "x", "c", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, _, _, tile, _ in tile_rows(batch, info.channels):
                core = tile.core()
                y, x, c = (a.ravel().astype(np.int32) for a in np.indices(core.shape))
                columns = [pa.array([image_id] * core.size, kinds[0]), *[pa.array(a) for a in (y + np.int32(tile.gy), x + np.int32(tile.gx), c, core.ravel().astype(np.int32))]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return tiles.mapInArrow(run, PIXEL)


def canvas_tiles(tiles: DataFrame, canvas: RasterInfo, tile_size: int, one_task: bool = False) -> DataFrame:
    """The whole canvas as a grid of tiles: pieces in raster order of the tiles they come from, so the last one wins,
    over zeros. A shuffle moves each piece once; samples are never rows."""
    columns, rows = grid_size(canvas.width, canvas.height, tile_size)
    names, kinds = ["to_row", "to_col", "tile_row", "tile_col", "y", "x", "h", "w", "piece"], [pa.int32()] * 8 + [pa.binary()]
    schema = ", ".join(f"{n} {'binary' if n == 'piece' else 'int'}" for n in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, col, tile, _ in tile_rows(batch, canvas.channels):
                if tile.gx + tile.cw > canvas.width or tile.gy + tile.ch > canvas.height:
                    raise ValueError(f"a tile reaches {tile.gx + tile.cw} x {tile.gy + tile.ch}, beyond the canvas of {canvas.width} x {canvas.height}")
                out, core = [], tile.core()
                for r in range(tile.gy // tile_size, (tile.gy + tile.ch - 1) // tile_size + 1):
                    for c in range(tile.gx // tile_size, (tile.gx + tile.cw - 1) // tile_size + 1):
                        top, left = max(tile.gy, r * tile_size), max(tile.gx, c * tile_size)
                        bottom, right = min(tile.gy + tile.ch, (r + 1) * tile_size), min(tile.gx + tile.cw, (c + 1) * tile_size)
                        part = core[top - tile.gy : bottom - tile.gy, left - tile.gx : right - tile.gx]
                        out.append((r, c, row, col, top, left, bottom - top, right - left, part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def lay(frame: pd.DataFrame) -> pd.DataFrame:
        row, col = int(frame["to_row"].iloc[0]), int(frame["to_col"].iloc[0])
        gx, gy = col * tile_size, row * tile_size
        cw, ch = min(tile_size, canvas.width - gx), min(tile_size, canvas.height - gy)
        whole = np.zeros((ch, cw, canvas.channels), np.uint8)
        for y, x, h, w, piece in zip(*(frame.sort_values(["tile_row", "tile_col"])[n] for n in names[4:]), strict=True):
            whole[y - gy : y - gy + h, x - gx : x - gx + w] = np.frombuffer(piece, np.uint8).reshape(h, w, canvas.channels)
        values = [canvas.image_id, row, col, gx, gy, cw, ch, 0, canvas.fmt, whole.tobytes()]
        return pd.DataFrame({n: [v] for n, v in zip(_NAMES, values, strict=True)})

    blank = tiles.sparkSession.range(columns * rows).selectExpr(f"cast(id div {columns} as int) to_row", f"cast(id % {columns} as int) to_col", "-1 tile_row", "-1 tile_col", "0 y", "0 x", "0 h", "0 w", "cast('' as binary) piece")
    blank = blank.withColumns({"y": F.col("to_row") * tile_size, "x": F.col("to_col") * tile_size})
    pieces = dealt(tiles.mapInArrow(cut, schema).unionByName(blank), ["to_row", "to_col"], one_task)
    return pieces.groupBy("to_row", "to_col").applyInPandas(lay, TILE)
