"""The raster queries in DuckDB SQL, written from the definitions and not from the Spark plans: sums over looked-up
neighbours instead of windows, four joins instead of one, unnested ranges instead of generated ids."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from rasterloom.operators.transforms import Blur, Crop, Resize, Rotate, Step

PIXELS = {
    "E": """SELECT CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, 0 AS c,
        CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 1.0::DOUBLE) * 128.0::DOUBLE), 0), 255) AS INTEGER) AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
    "V": """SELECT CAST(event_id // 50 AS INTEGER) AS y, CAST(event_id % 50 AS INTEGER) AS x, 0 AS c,
        CAST(floor(value) % 256 AS INTEGER) AS v FROM events""",
    "O": """SELECT CAST(o_orderkey // 50 AS INTEGER) AS y, CAST(o_orderkey % 50 AS INTEGER) AS x, CAST(k AS INTEGER) AS c,
        CAST(CASE k WHEN 0 THEN floor(o_totalprice) % 256 WHEN 1 THEN o_custkey % 256 ELSE day(o_orderdate) * 8 END AS INTEGER) AS v
        FROM (SELECT *, unnest(range(0, 3)) AS k FROM orders)""",
}
SIZES = {"E": "SELECT 64 AS w, (SELECT count(*) FROM embeddings) AS h", "V": "SELECT 50 AS w, (SELECT count(*) // 50 FROM events) AS h", "O": "SELECT 50 AS w, (SELECT count(*) // 50 FROM orders) AS h"}
CHANNELS = {"E": 1, "V": 1, "O": 3}


def at_border(v: str, n: str, mode: str) -> str:
    if mode == "zero":
        return f"(CASE WHEN {v} >= 0 AND {v} < {n} THEN {v} END)"
    if mode == "clamp":
        return f"least(greatest({v}, 0), {n} - 1)"
    m = f"(abs({v}) % greatest(2 * ({n} - 1), 1))"
    return f"(CASE WHEN {n} = 1 THEN 0 WHEN {m} >= {n} THEN 2 * ({n} - 1) - {m} ELSE {m} END)"


def head(raster: str) -> list[tuple[str, str]]:
    return [("px", PIXELS[raster]), ("dim", SIZES[raster])]


def grid(ts: str) -> tuple[str, str]:
    return "grid", f"""SELECT r AS tile_row, q AS tile_col, q * {ts} AS gx, r * {ts} AS gy, least({ts}, w - q * {ts}) AS cw, least({ts}, h - r * {ts}) AS ch, w, h
        FROM (SELECT r, w, h, unnest(range(0, (w + {ts} - 1) // {ts})) AS q FROM (SELECT w, h, unnest(range(0, (h + {ts} - 1) // {ts})) AS r FROM dim))"""


def unnested(rows: str, name: str, low: str, high: str) -> str:
    return f"(SELECT *, unnest(range({low}, {high})) AS {name} FROM {rows})"


def query(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


def buffers(raster: str, ts: int, halo: int, border: str) -> list[tuple[str, str]]:
    cells = unnested(unnested(unnested("grid", "by_", "0", f"ch + 2 * {halo}"), "bx_", "0", f"cw + 2 * {halo}"), "c", "0", str(CHANNELS[raster]))
    y, x = at_border(f"(gy + by_ - {halo})", "h", border), at_border(f"(gx + bx_ - {halo})", "w", border)
    return [*head(raster), grid(str(ts)), ("cells", f"SELECT *, {y} AS sy, {x} AS sx FROM {cells}"), ("buf", "SELECT k.tile_row, k.tile_col, gx, gy, cw, ch, by_, bx_, k.c, coalesce(p.v, 0) AS v FROM cells k LEFT JOIN px p ON p.y = k.sy AND p.x = k.sx AND p.c = k.c")]


BUFFER_COLUMNS = "CAST(tile_row AS INTEGER) AS tile_row, CAST(tile_col AS INTEGER) AS tile_col, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(cw AS INTEGER) AS cw, CAST(ch AS INTEGER) AS ch, CAST(by_ AS INTEGER) AS \"by\", CAST(bx_ AS INTEGER) AS bx, CAST(c AS INTEGER) AS c, CAST(v AS INTEGER) AS v"
CORE_COLUMNS = "CAST(tile_row AS INTEGER) AS tile_row, CAST(tile_col AS INTEGER) AS tile_col, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(cw AS INTEGER) AS cw, CAST(ch AS INTEGER) AS ch, CAST(ly AS INTEGER) AS ly, CAST(lx AS INTEGER) AS lx, CAST(c AS INTEGER) AS c, CAST(v AS INTEGER) AS v"


@dataclass
class ChainSql:
    """CTEs for a chain, step after step."""

    raster: str
    ts: str
    halo: int
    border: str
    ctes: list[tuple[str, str]] = field(default_factory=list)
    boxes: str = ""
    samples: str = ""
    k: int = 0

    def add(self, name: str, sql: str) -> str:
        self.ctes.append((f"{name}{self.k}", sql))
        return f"{name}{self.k}"

    def start(self) -> None:
        self.ctes = [*head(self.raster), grid(self.ts)]
        self.boxes = "grid"

    def tile_pixels(self, source: str) -> None:
        self.samples = self.add("smp", f"SELECT g.tile_row, g.tile_col, gx, gy, cw, ch, w, h, p.y - gy AS ly, p.x - gx AS lx, c, v FROM {source} p JOIN grid g ON g.tile_row = p.y // {self.ts} AND g.tile_col = p.x // {self.ts}")

    def step(self, step: Step) -> None:
        self.k += 1
        first = not self.samples
        if isinstance(step, Blur) and step.radius and first:
            source = "px"
            for along, n in (("x", "w"), ("y", "h")):
                r, count = step.radius, 2 * step.radius + 1
                other = "y" if along == "x" else "x"
                moved = at_border(f"(g.{along} + k)", n, self.border)
                source = self.add(f"pass{along}", f"""SELECT g.y, g.x, g.c, (CAST(sum(coalesce(p.v, 0)) AS BIGINT) + {count // 2}) // {count} AS v
                    FROM (SELECT y, x, c, w, h, unnest(range({-r}, {r + 1})) AS k FROM px, dim) g
                    LEFT JOIN {source} p ON p.{other} = g.{other} AND p.c = g.c AND p.{along} = {moved} GROUP BY g.y, g.x, g.c""")
            self.tile_pixels(source)
            return
        if isinstance(step, (Resize, Rotate)):
            self.resample(step, first)
            return
        if first:
            self.tile_pixels("px")
        if isinstance(step, Crop):
            cut = f"greatest(gx, {step.x0}) - {step.x0} AS gx, greatest(gy, {step.y0}) - {step.y0} AS gy, least(gx + cw, {step.x1}) - greatest(gx, {step.x0}) AS cw, least(gy + ch, {step.y1}) - greatest(gy, {step.y0}) AS ch, w, h"
            inside = f"greatest(gx, {step.x0}) < least(gx + cw, {step.x1}) AND greatest(gy, {step.y0}) < least(gy + ch, {step.y1})"
            self.boxes = self.add("box", f"SELECT tile_row, tile_col, {cut} FROM {self.boxes} WHERE {inside}")
            self.samples = self.add("cut", f"SELECT tile_row, tile_col, {cut}, gy + ly - greatest(gy, {step.y0}) AS ly, gx + lx - greatest(gx, {step.x0}) AS lx, c, v FROM {self.samples} WHERE gx + lx >= {step.x0} AND gx + lx < {step.x1} AND gy + ly >= {step.y0} AND gy + ly < {step.y1}")

    def resample(self, step: Step, first: bool) -> None:
        halo = self.halo if first else 0
        if isinstance(step, Resize):
            axis = lambda corner, size, s: f"CAST(floor(CAST({corner} AS FLOAT) * CAST({float(np.float32(s))!r} AS FLOAT)) AS INTEGER) AS n{corner}, CAST(ceil(CAST({corner} + {size} AS FLOAT) * CAST({float(np.float32(s))!r} AS FLOAT)) AS INTEGER) - CAST(floor(CAST({corner} AS FLOAT) * CAST({float(np.float32(s))!r} AS FLOAT)) AS INTEGER) AS n{size}"
            new = f"SELECT *, {axis('gx', 'cw', step.sx)}, {axis('gy', 'ch', step.sy)} FROM {self.boxes}"
            inverse = [repr(1.0 / float(np.float32(s))) if s else "0.0" for s in (step.sx, step.sy)]
            sx = f"(CAST(ngx + ox AS DOUBLE) + 0.5::DOUBLE) * {inverse[0]}::DOUBLE - 0.5::DOUBLE"
            sy = f"(CAST(ngy + oy AS DOUBLE) + 0.5::DOUBLE) * {inverse[1]}::DOUBLE - 0.5::DOUBLE"
            black = "FALSE"
        else:
            new = f"SELECT *, gx AS ngx, gy AS ngy, cw AS ncw, ch AS nch FROM {self.boxes}"
            angle = float(np.float32(step.degrees)) * math.pi / 180.0
            cos, sin, minus = (f"({x!r})" for x in (math.cos(angle), math.sin(angle), -math.sin(angle)))
            mx, my = "((w - 1.0::DOUBLE) * 0.5::DOUBLE)", "((h - 1.0::DOUBLE) * 0.5::DOUBLE)"
            dx, dy = f"(CAST(gx AS DOUBLE) + CAST(ox AS DOUBLE) - {mx})", f"(CAST(gy AS DOUBLE) + CAST(oy AS DOUBLE) - {my})"
            sx = f"{mx} + ({cos}::DOUBLE * {dx} + {sin}::DOUBLE * {dy})"
            sy = f"{my} + ({minus}::DOUBLE * {dx} + {cos}::DOUBLE * {dy})"
            black = f"bx < 0 OR bx >= cw + 2 * {halo} - 1 OR by_ < 0 OR by_ >= ch + 2 * {halo} - 1"
        boxes = self.add("new", new)
        cells = unnested(unnested(f"(SELECT * FROM {boxes} WHERE ncw > 0 AND nch > 0)", "oy", "0", "nch"), "ox", "0", "ncw")
        at = self.add("at", f"SELECT *, {sx} - (CAST(gx AS DOUBLE) - {halo}) AS bx, {sy} - (CAST(gy AS DOUBLE) - {halo}) AS by_ FROM {cells}")
        held = self.add("held", f"SELECT *, ({black}) AS black, least(greatest(bx, 0.0::DOUBLE), CAST(cw + 2 * {halo} - 1 AS DOUBLE)) AS hx, least(greatest(by_, 0.0::DOUBLE), CAST(ch + 2 * {halo} - 1 AS DOUBLE)) AS hy FROM {at}")
        cor = self.add("cor", f"SELECT *, CAST(floor(hx) AS BIGINT) AS x0, CAST(floor(hy) AS BIGINT) AS y0, least(CAST(floor(hx) AS BIGINT) + 1, cw + 2 * {halo} - 1) AS x1, least(CAST(floor(hy) AS BIGINT) + 1, ch + 2 * {halo} - 1) AS y1, hx - floor(hx) AS fx, hy - floor(hy) AS fy FROM {held}")
        chan = unnested(cor, "c", "0", str(CHANNELS[self.raster]))
        joins = []
        for name, x, y in (("p00", "x0", "y0"), ("p10", "x1", "y0"), ("p01", "x0", "y1"), ("p11", "x1", "y1")):
            if first:
                gx, gy = at_border(f"(k.gx + k.{x} - {halo})", "k.w", self.border), at_border(f"(k.gy + k.{y} - {halo})", "k.h", self.border)
                joins.append(f"LEFT JOIN px {name} ON {name}.c = k.c AND {name}.x = {gx} AND {name}.y = {gy}")
            else:
                joins.append(f"LEFT JOIN {self.samples} {name} ON {name}.c = k.c AND {name}.tile_row = k.tile_row AND {name}.tile_col = k.tile_col AND {name}.lx = k.{x} AND {name}.ly = k.{y}")
        p = {n: f"CAST(coalesce({n}.v, 0) AS DOUBLE)" for n in ("p00", "p10", "p01", "p11")}
        value = f"(1.0::DOUBLE - fy) * ((1.0::DOUBLE - fx) * {p['p00']} + fx * {p['p10']}) + fy * ((1.0::DOUBLE - fx) * {p['p01']} + fx * {p['p11']})"
        self.samples = self.add("smp", f"SELECT k.tile_row, k.tile_col, ngx AS gx, ngy AS gy, ncw AS cw, nch AS ch, k.w, k.h, oy AS ly, ox AS lx, k.c, CASE WHEN black THEN 0 ELSE CAST(floor(least(greatest({value}, 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) END AS v FROM {chan} k {' '.join(joins)}")
        self.boxes = self.add("box", f"SELECT tile_row, tile_col, ngx AS gx, ngy AS gy, ncw AS cw, nch AS ch, w, h FROM {boxes} WHERE ncw > 0 AND nch > 0")


def chain_ctes(raster: str, steps: list[Step], ts: int | str, halo: int, border: str = "clamp") -> ChainSql:
    sql = ChainSql(raster, str(ts), halo, border)
    sql.start()
    for step in steps:
        sql.step(step)
    return sql


def mosaic_cte(sql: ChainSql) -> tuple[str, str]:
    return "mos", f"SELECT gy + ly AS y, gx + lx AS x, c, arg_max(v, tile_row * 1000000 + tile_col) AS v FROM {sql.samples} GROUP BY 1, 2, 3"


def render_sql(raster: str, steps: list[Step], ts: int | str, halo: int, border: str = "clamp") -> str:
    """The whole canvas of the input's size."""
    sql = chain_ctes(raster, steps, ts, halo, border)
    cells = unnested(unnested(unnested("dim", "y", "0", "h"), "x", "0", "w"), "c", "0", str(CHANNELS[raster]))
    body = f"SELECT '{raster}' AS image_id, CAST(k.y AS INTEGER) AS y, CAST(k.x AS INTEGER) AS x, CAST(k.c AS INTEGER) AS c, CAST(coalesce(m.v, 0) AS INTEGER) AS v FROM {cells} k LEFT JOIN mos m ON m.y = k.y AND m.x = k.x AND m.c = k.c"
    return query([*sql.ctes, mosaic_cte(sql)], body)
