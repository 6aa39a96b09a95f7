"""Registered raster queries and their DuckDB equivalents."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import oracle
from rasterloom.functions import color
from rasterloom.model import RasterInfo, RunConfig
from rasterloom.operators import grid, halo, mosaic, single
from rasterloom.operators import tiles as tile_ops
from rasterloom.operators.transforms import Blur, Crop, Identity, Origin, Resize, Rotate, Step
from rasterloom.plans import chain as chains
from rasterloom.plans import metrics, routing
from rasterloom.sources import store, synthetic, tables, tiff

RASTERS = {"E": tables.embedding_raster, "V": tables.event_raster, "O": tables.order_raster}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def image(name: str, raster: str, steps: list[Step], tile_size: int, halo: int, border: str = "clamp", engine: str = "pixels") -> None:
    """A query that renders a chain over a raster by one of the two engines."""
    chain, config = chains.Chain(tuple(steps)), RunConfig(tile_size=tile_size, halo=halo, border=border)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels, info = RASTERS[raster](spark, sf_dir)
        if engine == "pixels":
            return chains.render(pixels, info, chain, config)
        tiles = chains.render_tiles(tile_ops.tiles_from_pixels(pixels, info, tile_size), info, chain, config)
        return tile_ops.pixels_from_tiles(tiles, info)

    register(name, run, oracle.render_sql(raster, steps, tile_size, max(halo, chain.halo), border))


# -- sources -----------------------------------------------------------------------------------------------------

for _r in RASTERS:
    register(f"raster_load_{_r.lower()}", lambda spark, sf_dir, r=_r: RASTERS[r](spark, sf_dir)[0], f"SELECT '{_r}' AS image_id, * FROM ({oracle.PIXELS[_r]})")


def _info_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [RASTERS[r](spark, sf_dir)[1] for r in RASTERS]
    rows = [(i.image_id, i.width, i.height, i.fmt, i.channels) for i in found]
    return spark.createDataFrame(rows, "image_id string, width int, height int, fmt string, channels int")


register(
    "raster_info",
    _info_row,
    " UNION ALL ".join(f"SELECT '{r}' AS image_id, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, '{'RGB8' if oracle.CHANNELS[r] == 3 else 'GRAY8'}' AS fmt, {oracle.CHANNELS[r]} AS channels FROM ({oracle.SIZES[r]})" for r in RASTERS),
)
_CELLS = "(SELECT y, unnest(range(0, {w})) AS x FROM (SELECT unnest(range(0, {h})) AS y))"
_F = lambda v, n, s: f"(CAST({v} AS FLOAT) / CAST({n} AS FLOAT) * CAST({s} AS FLOAT))"
register(
    "synthetic_rgb",
    lambda spark, sf_dir: synthetic.checkerboard(spark, 300, 200, block=64)[0],
    f"""SELECT 'G' AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(c AS INTEGER) AS c, CAST(CASE c
      WHEN 0 THEN floor({_F("x", 300, 200)} + CAST(30 AS FLOAT)) WHEN 1 THEN floor({_F("y", 200, 200)} + CAST(30 AS FLOAT))
      ELSE ((y // 64 + x // 64) % 2) * 200 + 20 END AS INTEGER) AS v FROM (SELECT *, unnest(range(0, 3)) AS c FROM {_CELLS.format(w=300, h=200)})""",
)
register(
    "synthetic_gray",
    lambda spark, sf_dir: synthetic.checkerboard(spark, 256, 256, gray=True)[0],
    f"""SELECT 'G' AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 0 AS c,
      CAST((((y // 128 + x // 128) % 2) * 180 + 30 + CAST(floor({_F("y", 256, 50)} + {_F("x", 256, 50)}) AS INTEGER)) % 256 AS INTEGER) AS v FROM {_CELLS.format(w=256, h=256)}""",
)

# -- grid and halo -----------------------------------------------------------------------------------------------

_BOX = ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in ("tile_row", "tile_col", "gx", "gy", "cw", "ch"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(spark, tables.event_raster(spark, sf_dir)[1], 16)


register("tile_grid", _grid, oracle.query([*oracle.head("V"), oracle.grid("16")], f"SELECT {_BOX} FROM grid"))


def _buffers(raster: str, tile_size: int, ring: int, border: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels, info = RASTERS[raster](spark, sf_dir)
        return halo.read_tiles(pixels, info, tile_size, ring, border)

    return run


for _b in ("zero", "clamp", "reflect"):
    register(f"tile_read_halo_{_b}", _buffers("V", 20, 3, _b), oracle.query(oracle.buffers("V", 20, 3, _b), f"SELECT {oracle.BUFFER_COLUMNS} FROM buf"))
register(
    "strip_halo",
    lambda spark, sf_dir: halo.strip_halo(_buffers("O", 32, 2, "clamp")(spark, sf_dir), 2),
    oracle.query(oracle.buffers("O", 32, 2, "clamp"), f"SELECT {oracle.CORE_COLUMNS} FROM (SELECT *, by_ - 2 AS ly, bx_ - 2 AS lx FROM buf) WHERE ly >= 0 AND ly < ch AND lx >= 0 AND lx < cw"),
)
for _b in ("zero", "clamp", "reflect"):
    register(
        f"fill_halo_{_b}",
        lambda spark, sf_dir, b=_b: halo.fill_halo(_buffers("V", 20, 3, "clamp")(spark, sf_dir), 3, b),
        oracle.query(
            oracle.buffers("V", 20, 3, "clamp"),
            f"SELECT {oracle.BUFFER_COLUMNS} FROM (SELECT a.* REPLACE (coalesce(b.v, 0) AS v) FROM buf a LEFT JOIN buf b ON b.tile_row = a.tile_row AND b.tile_col = a.tile_col AND b.c = a.c AND b.by_ - 3 = {oracle.at_border('(a.by_ - 3)', 'a.ch', _b)} AND b.bx_ - 3 = {oracle.at_border('(a.bx_ - 3)', 'a.cw', _b)})",
        ),
    )
_TINT = """SELECT * EXCLUDE (c0, c1, c2), k AS c, CASE WHEN by_ >= 2 AND by_ < 2 + ch AND bx_ >= 2 AND bx_ < 2 + cw
    THEN CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE 255 END ELSE CASE k WHEN 0 THEN least(255, c0 + 80) WHEN 3 THEN 200 ELSE c0 // 3 END END AS v
    FROM (SELECT *, unnest(range(0, 4)) AS k FROM (SELECT tile_row, tile_col, gx, gy, cw, ch, by_, bx_, max(v) FILTER (c = 0) AS c0, max(v) FILTER (c = 1) AS c1, max(v) FILTER (c = 2) AS c2 FROM buf GROUP BY ALL))"""
register(
    "visualise_halo",
    lambda spark, sf_dir: halo.visualise_halo(_buffers("O", 32, 2, "clamp")(spark, sf_dir), tables.order_raster(spark, sf_dir)[1], 2),
    oracle.query(oracle.buffers("O", 32, 2, "clamp"), f"SELECT {oracle.BUFFER_COLUMNS} FROM ({_TINT})"),
)

# -- steps and chains --------------------------------------------------------------------------------------------

image("identity", "O", [Identity()], 32, 16)
image("crop", "O", [Crop(7, 11, 41, 90)], 32, 16)
image("crop_crop", "O", [Crop(7, 5, 45, 90), Crop(3, 4, 30, 60)], 16, 16)
image("crop_shifted", "O", [Crop(-6, -3, 20, 25)], 16, 16)
image("crop_outside", "V", [Crop(5000, 5000, 5100, 5100)], 32, 16)
image("resize_half", "O", [Resize(0.5, 0.5)], 32, 16)
image("resize_aniso", "E", [Resize(0.3, 0.7)], 50, 16)
image("resize_crop_double", "O", [Crop(2, 3, 22, 17), Resize(2.0, 2.0)], 32, 16)
image("resize_zero", "V", [Resize(0.0, 0.0)], 32, 16)
image("rotate_tile", "E", [Rotate(20.0)], 64, 16)
image("rotate_small_tiles", "O", [Rotate(-35.5)], 16, 16, "reflect")
image("rotate_zero_later", "O", [Identity(), Rotate(0.0)], 16, 16)
for _k in (1, 4, 8):
    image(f"blur_r{_k}", "O" if _k == 4 else "E", [Blur(_k)], 32, 16)
image("blur_border_zero", "O", [Blur(3)], 32, 16, "zero")
image("blur_border_reflect", "O", [Blur(3)], 32, 16, "reflect")
image("chain_blur_crop", "O", [Blur(4), Crop(5, 5, 45, 80)], 32, 16)
image("chain_rotate_resize", "O", [Rotate(30.0), Resize(0.5, 0.5)], 32, 16)
image("chain_crop_rotate", "E", [Crop(4, 4, 60, 200), Rotate(10.0)], 32, 16)
image("tiles_identity", "O", [Identity()], 32, 16, engine="tiles")
image("tiles_crop", "O", [Crop(7, 11, 41, 90)], 32, 16, engine="tiles")
image("tiles_blur", "O", [Blur(4)], 32, 16, engine="tiles")
image("tiles_blur_reflect", "E", [Blur(8)], 20, 16, "reflect", engine="tiles")
image("tiles_blur_zero", "E", [Blur(3)], 20, 16, "zero", engine="tiles")
image("tiles_resize", "E", [Resize(0.3, 0.7)], 50, 16, engine="tiles")
image("tiles_rotate", "E", [Rotate(20.0)], 64, 16, engine="tiles")
image("tiles_chain", "O", [Rotate(30.0), Resize(0.5, 0.5)], 32, 16, engine="tiles")


def _rotate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, info = tables.embedding_raster(spark, sf_dir)
    return chains.render_global(pixels, info, chains.Chain((Rotate(20.0),)), "clamp")


register("rotate_global", _rotate_global, oracle.render_sql("E", [Rotate(20.0)], "(SELECT greatest(w, h) FROM dim)", 256))


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, info = tables.embedding_raster(spark, sf_dir)
    tiles = chains.run_on_pixels(pixels, info, chains.Chain((Resize(0.3, 0.3),)), RunConfig(tile_size=50))
    return mosaic.mosaic(tiles)


_sql = oracle.chain_ctes("E", [Resize(0.3, 0.3)], 50, 16)
register("mosaic", _mosaic, oracle.query([*_sql.ctes, oracle.mosaic_cte(_sql)], "SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(c AS INTEGER) AS c, CAST(v AS INTEGER) AS v FROM mos"))


def _canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths of the width and three of the height are laid down, the rest is zero."""
    pixels, info = tables.order_raster(spark, sf_dir)
    part = pixels.where((F.col("x") * 5 < info.width * 2) & (F.col("y") * 5 < info.height * 3))
    return mosaic.on_canvas(part.select("y", "x", "c", "v"), info)


register(
    "canvas",
    _canvas,
    "WITH px AS (" + oracle.PIXELS["O"] + "), dim AS (" + oracle.SIZES["O"] + ") SELECT 'O' AS image_id, y, x, c, CASE WHEN x * 5 < w * 2 AND y * 5 < h * 3 THEN v ELSE 0 END AS v FROM px, dim WHERE y < h",
)
_SIZES = ["identity", "blur 4", "rotate 30", "crop 5 5 45 80", "resize 0.3 0.7", "rotate 30 | resize 0.5 0.5", "crop 5 5 45 80 | resize 2 2", "crop 60 0 20 10"]


def _output_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(line, *chains.Chain.parse(line).output_size(1001, 777)) for line in _SIZES]
    return spark.createDataFrame(rows, "chain string, width int, height int")


register(
    "output_size",
    _output_size,
    "SELECT * FROM (VALUES ('identity', 1001, 777), ('blur 4', 1001, 777), ('rotate 30', 1001, 777), ('crop 5 5 45 80', 40, 75), ('resize 0.3 0.7', CAST(round(1001 * 0.3::DOUBLE) AS INTEGER), CAST(round(777 * 0.7::DOUBLE) AS INTEGER)), ('rotate 30 | resize 0.5 0.5', 501, 389), ('crop 5 5 45 80 | resize 2 2', 80, 150), ('crop 60 0 20 10', 0, 10)) t(chain, width, height)",
)

# -- single precision --------------------------------------------------------------------------------------------

_S = lambda x: f"CAST({x} AS FLOAT)"


def _single_sql(points: str, width: str, height: str, channels: int, pixels: str, more: str = "") -> str:
    """points: (y, x, fx, fy); pixels: (y, x, c, v)."""
    held = lambda v, n: f"greatest({_S(0)}, least({v}, CAST({n} - 1 AS FLOAT)))"
    p = {n: f"CAST(coalesce({n}.v, 0) AS FLOAT)" for n in ("p00", "p10", "p01", "p11")}
    value = f"({_S(1)} - dy) * (({_S(1)} - dx) * {p['p00']} + dx * {p['p10']}) + dy * (({_S(1)} - dx) * {p['p01']} + dx * {p['p11']})"
    joins = " ".join(f"LEFT JOIN px {n} ON {n}.c = k.c AND {n}.x = k.{x} AND {n}.y = k.{y}" for n, x, y in (("p00", "x0", "y0"), ("p10", "x1", "y0"), ("p01", "x0", "y1"), ("p11", "x1", "y1")))
    return f"""WITH px AS ({pixels}), spot AS (SELECT y, x, {held("fx", width)} AS hx, {held("fy", height)} AS hy FROM ({points})),
    cor AS (SELECT y, x, CAST(floor(hx) AS INTEGER) AS x0, CAST(floor(hy) AS INTEGER) AS y0, least(CAST(floor(hx) AS INTEGER) + 1, {width} - 1) AS x1, least(CAST(floor(hy) AS INTEGER) + 1, {height} - 1) AS y1,
      hx - CAST(floor(hx) AS FLOAT) AS dx, hy - CAST(floor(hy) AS FLOAT) AS dy, unnest(range(0, {channels})) AS c FROM spot)
    SELECT CAST(k.y AS INTEGER) AS y, CAST(k.x AS INTEGER) AS x, CAST(k.c AS INTEGER) AS c, CAST(floor(greatest({_S(0)}, least({value}, {_S(255)}))) AS INTEGER) AS v FROM cor k {joins}{more}"""


def _bilinear_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, info = tables.embedding_raster(spark, sf_dir)
    places = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).alias("y"), F.col("event_id").cast("int").alias("x"), (single.single(F.col("value") % 80) - single.single(5.0)).alias("fx"), (single.single(F.col("event_id") % 997) * single.single(0.37)).alias("fy"))
    return single.sample_points(places, ["y", "x"], pixels, info)


_H = "(SELECT count(*) FROM embeddings)"
register("bilinear_single", _bilinear_single, _single_sql(f"SELECT 0 AS y, event_id AS x, {_S('value % 80')} - {_S(5)} AS fx, {_S('event_id % 997')} * {_S(0.37)} AS fy FROM events", "64", _H, 1, oracle.PIXELS["E"]))


def _resize_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, info = tables.embedding_raster(spark, sf_dir)
    return single.resize_single(pixels, info, 45, info.height * 3 // 10, 0.7, 0.3)


register(
    "resize_single",
    _resize_single,
    _single_sql(f"SELECT y, x, ({_S('x')} + {_S(0.5)}) / {_S(0.7)} - {_S(0.5)} AS fx, ({_S('y')} + {_S(0.5)}) / {_S(0.3)} - {_S(0.5)} AS fy FROM (SELECT y, unnest(range(0, 45)) AS x FROM (SELECT unnest(range(0, {_H} * 3 // 10)) AS y))", "64", _H, 1, oracle.PIXELS["E"]),
)


def _rotate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A core as wide as the image less 8 and as high as half of it, read from a buffer that is larger by 3 on each side."""
    pixels, info = tables.order_raster(spark, sf_dir)
    height = info.height // 2
    return single.rotate_single(pixels, info, 17.3, (4, 5, 42, height), (1, 2, 48, height + 6), ((info.width - 1) * 0.5, (info.height - 1) * 0.5))


_angle = float(np.float32(17.3)) * math.pi / 180.0
_cos, _sin, _minus = (_S(repr(float(np.float32(x)))) for x in (math.cos(_angle), math.sin(_angle), -math.sin(_angle)))
_mid_x, _mid_y = _S(24.5), "CAST((h - 1) * 0.5 AS FLOAT)"
_dx, _dy = f"({_S(4)} + {_S('x')} - {_mid_x})", f"({_S(5)} + {_S('y')} - {_mid_y})"
_turned = f"""SELECT y, x, h, {_mid_x} + ({_cos} * {_dx} + {_sin} * {_dy}) - {_S(1)} AS fx, {_mid_y} + ({_minus} * {_dx} + {_cos} * {_dy}) - {_S(2)} AS fy
    FROM (SELECT *, unnest(range(0, 42)) AS x FROM (SELECT h, unnest(range(0, h // 2)) AS y FROM ({oracle.SIZES["O"]})))"""
_seen = f"(fx >= 0 AND fx < {_S(47)} AND fy >= 0 AND fy < CAST(h // 2 + 5 AS FLOAT))"
_half = "(SELECT count(*) // 50 // 2 + 6 FROM orders)"
register(
    "rotate_single",
    _rotate_single,
    _single_sql(
        f"SELECT y, x, fx, fy FROM ({_turned}) WHERE {_seen}", "48", _half, 3,
        f"SELECT y - 2 AS y, x - 1 AS x, c, v FROM ({oracle.PIXELS['O']}) WHERE x >= 1 AND x < 49 AND y >= 2 AND y < 2 + {_half}",
        f" UNION ALL SELECT CAST(y AS INTEGER), CAST(x AS INTEGER), CAST(unnest(range(0, 3)) AS INTEGER), 0 FROM ({_turned}) WHERE NOT {_seen}",
    ),
)

# -- files -------------------------------------------------------------------------------------------------------


def _through_a_file(spark: SparkSession, sf_dir: str, raster: str, tile_size: int) -> DataFrame:
    """A raster written as TIFF and read again by tiles of another size."""
    pixels, info = RASTERS[raster](spark, sf_dir)
    pixels = pixels.where((F.col("y") < info.height) & (F.col("x") < info.width))
    path = f"{store.shared_folder(spark)}/round-trip-{uuid.uuid4().hex}.tiff"
    tiff.write_tiff(tile_ops.tiles_from_pixels(pixels, info, 32), info, path)
    store.delete_at_end(spark, path)
    tiles, found = tiff.read_tiff(spark, path, tile_size, raster)
    return tile_ops.pixels_from_tiles(tiles, found)


for _r in ("O", "V"):
    register(
        f"tiff_round_trip_{_r.lower()}",
        lambda spark, sf_dir, r=_r: _through_a_file(spark, sf_dir, r, 20),
        f"WITH px AS ({oracle.PIXELS[_r]}), dim AS ({oracle.SIZES[_r]}) SELECT '{_r}' AS image_id, px.* FROM px, dim WHERE y < h",
    )

# -- colour ------------------------------------------------------------------------------------------------------

_WIDE = f"SELECT y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM ({oracle.PIXELS['O']}) GROUP BY y, x"
_HSV = f"""
 one AS (SELECT y, x, {_S("r")} / {_S(255)} AS r, {_S("g")} / {_S(255)} AS g, {_S("b")} / {_S(255)} AS b FROM ({_WIDE})),
 two AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM one),
 three AS (SELECT *, CASE WHEN d > {_S("1e-6")} THEN {_S(60)} * CASE WHEN mx = r THEN ((g - b) / d) % {_S(6)} WHEN mx = g THEN (b - r) / d + {_S(2)} ELSE (r - g) / d + {_S(4)} END ELSE {_S(0)} END AS h FROM two),
 hsv AS (SELECT y, x, CAST(floor(CASE WHEN h < 0 THEN h + {_S(360)} ELSE h END * {_S(0.5)}) AS INTEGER) AS h,
   CAST(floor(CASE WHEN mx > {_S("1e-6")} THEN d / mx ELSE {_S(0)} END * {_S(255)} + {_S(0.5)}) AS INTEGER) AS s, CAST(floor(mx * {_S(255)} + {_S(0.5)}) AS INTEGER) AS v FROM three)"""
_RGB = f"""
 a AS (SELECT y, x, {_S("h")} * {_S(2)} AS h, {_S("s")} / {_S(255)} AS s, {_S("v")} / {_S(255)} AS v FROM hsv),
 b AS (SELECT *, v * s AS p, h / {_S(60)} AS t FROM a),
 e AS (SELECT *, p * ({_S(1)} - abs(t % {_S(2)} - {_S(1)})) AS q, v - p AS m, CAST(floor(t) AS INTEGER) % 6 AS k FROM b),
 f AS (SELECT y, x, m, CASE WHEN k IN (0, 5) THEN p WHEN k IN (1, 4) THEN q ELSE {_S(0)} END AS r, CASE WHEN k IN (1, 2) THEN p WHEN k IN (0, 3) THEN q ELSE {_S(0)} END AS g,
   CASE WHEN k IN (3, 4) THEN p WHEN k IN (2, 5) THEN q ELSE {_S(0)} END AS b FROM e)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_raster(spark, sf_dir)[0]


register("rgb_to_gray", lambda spark, sf_dir: color.rgb_to_gray(_orders(spark, sf_dir)), f"SELECT 'O' AS image_id, y, x, 0 AS c, CAST((306 * r + 601 * g + 117 * b) // 1024 AS INTEGER) AS v FROM ({_WIDE})")
register("gray_to_rgb", lambda spark, sf_dir: color.gray_to_rgb(tables.embedding_raster(spark, sf_dir)[0]), f"SELECT 'E' AS image_id, y, x, CAST(unnest(range(0, 3)) AS INTEGER) AS c, v FROM ({oracle.PIXELS['E']})")
register("rgb_to_hsv", lambda spark, sf_dir: color.rgb_to_hsv(_orders(spark, sf_dir)), f"WITH {_HSV} SELECT 'O' AS image_id, y, x, CAST(k AS INTEGER) AS c, CASE k WHEN 0 THEN h WHEN 1 THEN s ELSE v END AS v FROM (SELECT *, unnest(range(0, 3)) AS k FROM hsv)")
register(
    "hsv_to_rgb",
    lambda spark, sf_dir: color.hsv_to_rgb(color.rgb_to_hsv(_orders(spark, sf_dir))),
    f"WITH {_HSV}, {_RGB} SELECT 'O' AS image_id, y, x, CAST(c AS INTEGER) AS c, CAST(floor((CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END + m) * {_S(255)} + {_S(0.5)}) AS INTEGER) AS v FROM (SELECT *, unnest(range(0, 3)) AS c FROM f)",
)

# -- routing and metrics -----------------------------------------------------------------------------------------

_WIDE_INFO = RasterInfo("R", 1408, 1300, "RGBA8")


def _routed(spark: SparkSession, line: str) -> DataFrame:
    chain = chains.Chain.parse(line)
    boxes = grid.tile_grid(spark, _WIDE_INFO, 512).select("*", F.lit(max(16, chain.halo)).alias("halo"), F.lit(_WIDE_INFO.channels).alias("channels"))
    return routing.route_tiles(boxes, chain).select(F.lit(line).alias("chain"), "tile_row", "tile_col", "cw", "ch", "halo", "device", "reason")


def _route_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [_routed(spark, line) for line in ("identity", "blur 4", "rotate 30")]
    return found[0].unionByName(found[1]).unionByName(found[2])


_ROUTES = """
WITH g AS (SELECT r, q, least(512, 1408 - q * 512) AS cw, least(512, 1300 - r * 512) AS ch FROM (SELECT r, unnest(range(0, 3)) AS q FROM (SELECT unnest(range(0, 3)) AS r))),
l AS (SELECT * FROM (VALUES ('identity', 16, FALSE), ('blur 4', 16, TRUE), ('rotate 30', 256, TRUE)) t(chain, halo, heavy)),
t AS (SELECT *, (cw * ch / 3e8::DOUBLE) / ((cw + 2 * halo) * (ch + 2 * halo) * 4 * 2 / 8e9::DOUBLE + 1e-12::DOUBLE) AS ratio FROM g, l),
routes AS (SELECT chain, CAST(r AS INTEGER) AS tile_row, CAST(q AS INTEGER) AS tile_col, CAST(cw AS INTEGER) AS cw, CAST(ch AS INTEGER) AS ch, halo,
  CASE WHEN heavy AND ratio >= 1 THEN 'GPU' ELSE 'CPU' END AS device,
  CASE WHEN NOT heavy THEN 'CPU preferred for identity/crop' WHEN ratio < 1 THEN 'PCIe transfer dominates' ELSE 'Compute-heavy transform' END AS reason FROM t)
"""
register("route_tiles", _route_tiles, _ROUTES + "SELECT * FROM routes")
register("route_summary", lambda spark, sf_dir: routing.route_summary(_route_tiles(spark, sf_dir)), _ROUTES + "SELECT device, reason, count(*) AS n_tiles FROM routes GROUP BY device, reason")


_REASONS = {"no gpu": (routing.SchedulerConfig(gpu_available=False), 0.0), "small tiles": (routing.SchedulerConfig(min_gpu_tile_pixels=512 * 512), 0.0), "full": (routing.SchedulerConfig(bytes_per_sec=1e12), 1.7), "free": (routing.SchedulerConfig(bytes_per_sec=1e12), -0.4)}


def _route_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancies beyond 0 and 1 count as 0 and 1."""
    boxes = grid.tile_grid(spark, _WIDE_INFO, 512).select("*", F.lit(16).alias("halo"), F.lit(4).alias("channels"))
    found = [routing.route_tiles(boxes, chains.Chain.parse("blur 4"), config, full).select(F.lit(name).alias("case"), "tile_row", "tile_col", "device", "reason") for name, (config, full) in _REASONS.items()]
    return functools.reduce(DataFrame.unionByName, found)


register(
    "route_reasons",
    _route_reasons,
    """WITH g AS (SELECT r, q, least(512, 1408 - q * 512) AS cw, least(512, 1300 - r * 512) AS ch FROM (SELECT r, unnest(range(0, 3)) AS q FROM (SELECT unnest(range(0, 3)) AS r))),
    s AS (SELECT * FROM (VALUES ('no gpu', FALSE, 1, 8e9::DOUBLE, 0.0::DOUBLE), ('small tiles', TRUE, 262144, 8e9::DOUBLE, 0.0::DOUBLE), ('full', TRUE, 1, 1e12::DOUBLE, 1.0::DOUBLE), ('free', TRUE, 1, 1e12::DOUBLE, 0.0::DOUBLE)) t(name, gpu, least_pixels, rate, occupancy)),
    t AS (SELECT *, (cw * ch / 3e8::DOUBLE) / ((cw + 32) * (ch + 32) * 4 * 2 / rate + 1e-12::DOUBLE) AS ratio FROM g, s),
    u AS (SELECT *, CASE WHEN NOT gpu THEN 'No GPU available' WHEN cw * ch < least_pixels THEN 'Tile too small for GPU' WHEN ratio < 1 THEN 'PCIe transfer dominates' WHEN occupancy >= 0.99 THEN 'GPU queue full' ELSE 'Compute-heavy transform' END AS reason FROM t)
    SELECT name AS "case", CAST(r AS INTEGER) AS tile_row, CAST(q AS INTEGER) AS tile_col, CASE reason WHEN 'Compute-heavy transform' THEN 'GPU' ELSE 'CPU' END AS device, reason FROM u""",
)
_CHECKS = {"blur 16": 16, "blur 17": 16, "blur 3 | crop 0 0 9 9": 2, "identity | blur 1": 16, "identity | blur 0": 16, "crop 0 0 9 9 | rotate 5": 0}


def _halo_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a buffer's halo, given beside the chain, and the place of a blur allow the chain."""

    def fine(line: str, ring: int) -> bool:
        chain = chains.Chain.parse(line)
        try:
            chain.check()
            halo.check_halo(ring, getattr(chain.steps[0], "radius", 0), "blur")
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(line, ring, fine(line, ring)) for line, ring in _CHECKS.items()], "chain string, halo int, fine boolean")


register("halo_checks", _halo_checks, "SELECT * FROM (VALUES ('blur 16', 16, TRUE), ('blur 17', 16, FALSE), ('blur 3 | crop 0 0 9 9', 2, FALSE), ('identity | blur 1', 16, FALSE), ('identity | blur 0', 16, TRUE), ('crop 0 0 9 9 | rotate 5', 0, TRUE)) t(chain, halo, fine)")


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("device"), F.col("event_id").alias("seq"), (F.col("value") / 1000.0).alias("seconds"), F.lit(262144).alias("pixels"))


register(
    "ewma",
    lambda spark, sf_dir: routing.learned_rate(_timings(spark, sf_dir), ["device"], "seq", 1000.0).select("device", "n", F.round("rate", 6).alias("rate")),
    """SELECT event_type AS device, count(*) AS n, round(list_reduce(list(262144 / (value / 1000.0::DOUBLE * 1e6::DOUBLE) ORDER BY event_id), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x, 1000.0::DOUBLE), 6) AS rate
    FROM events WHERE value > 0 GROUP BY event_type""",
)


def _device_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by turns on two devices, and a reset at every two-thousandth event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    device = F.when(F.col("event_id") % 3 == 0, "GPU").otherwise("CPU")
    return events.select(F.col("event_id").alias("seq"), device.alias("device"), (F.col("value") / 1000.0).alias("seconds"), F.lit(262144).alias("pixels"), (F.col("event_id") % 2000 == 700).alias("reset"))


register(
    "scheduler_stats",
    lambda spark, sf_dir: routing.scheduler_stats(_device_log(spark, sf_dir)).select("device", "n_tiles", F.round("rate", 6).alias("rate")),
    """WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'GPU' ELSE 'CPU' END AS device, value / 1000.0::DOUBLE AS s, event_id % 2000 = 700 AS reset FROM events),
    z AS (SELECT max(event_id) FILTER (reset) AS last FROM l),
    r AS (SELECT device, round(list_reduce(list(262144 / (s * 1e6::DOUBLE) ORDER BY event_id) FILTER (s > 0), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x, CASE device WHEN 'GPU' THEN 1000.0::DOUBLE ELSE 100.0::DOUBLE END), 6) AS rate FROM l WHERE NOT reset GROUP BY device)
    SELECT device, count(*) FILTER (last IS NULL OR event_id > last) AS n_tiles, rate FROM l JOIN r USING (device) CROSS JOIN z WHERE NOT reset GROUP BY device, rate""",
)


def _tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, info = tables.order_raster(spark, sf_dir)
    boxes = Crop(7, 11, 41, 90).first(Origin(info, pixels, 16, 16, "clamp")).boxes
    return metrics.tile_stats(grid.tile_grid(spark, info, 16), boxes)


register(
    "tile_stats",
    _tile_stats,
    oracle.query([*oracle.head("O"), oracle.grid("16")], "SELECT count(*) AS tiles_read, count(*) FILTER (hit) AS tiles_processed, count(*) FILTER (NOT hit) AS tiles_skipped, count(*) FILTER (hit) AS tiles_written FROM (SELECT greatest(gx, 7) < least(gx + cw, 41) AND greatest(gy, 11) < least(gy + ch, 90) AS hit FROM grid)"),
)


def _speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = _timings(spark, sf_dir)
    parallel = timings.groupBy((F.col("seq") % 8).alias("worker")).agg(F.sum("seconds").alias("s")).agg(F.max("s").alias("elapsed_sec")).select(F.lit("parallel").alias("mode"), "elapsed_sec")
    runs = timings.agg(F.sum("seconds").alias("elapsed_sec")).select(F.lit("sequential").alias("mode"), "elapsed_sec").unionByName(parallel)
    return metrics.speedup(runs, 8).select(*[F.round(c, 6).alias(c) for c in ("sequential_sec", "parallel_sec", "speedup", "efficiency")])


register(
    "speedup",
    _speedup,
    """WITH t AS (SELECT event_id % 8 AS worker, sum(value / 1000.0::DOUBLE) AS s FROM events GROUP BY 1), u AS (SELECT sum(s) AS a, max(s) AS b FROM t)
    SELECT round(a, 6) AS sequential_sec, round(b, 6) AS parallel_sec, round(a / b, 6) AS speedup, round(a / b / 8 * 100, 6) AS efficiency FROM u""",
)
register(
    "throughput",
    lambda spark, sf_dir: _info_row(spark, sf_dir).select("image_id", F.round(metrics.throughput(F.col("width"), F.col("height"), F.lit(0.25)), 9).alias("mpix_per_sec")),
    " UNION ALL ".join(f"SELECT '{r}' AS image_id, round(w * h / 1e6::DOUBLE / 0.25::DOUBLE, 9) AS mpix_per_sec FROM ({oracle.SIZES[r]})" for r in RASTERS),
)
