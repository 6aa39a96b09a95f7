"""Command line: `run` a chain over a TIFF file, `generate` a test image.

Exit codes: 0 success, 1 bad arguments, 2 a failure while running.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo, RunConfig
from rasterloom.operators import tiles as tile_ops
from rasterloom.operators.grid import grid_size, tile_grid
from rasterloom.plans import metrics, routing
from rasterloom.plans.chain import Chain, effective_halo, run_on_tiles
from rasterloom.sources import synthetic, tiff

MODES = ("parallel", "sequential", "both", "hetero", "hetero-bench")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        raise SystemExit(f"{self.prog}: {message}") from None


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="rasterloom")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    run = commands.add_parser("run", help="run a chain of steps over an image")
    run.add_argument("input")
    run.add_argument("output")
    run.add_argument("--mode", choices=MODES, default="parallel")
    run.add_argument("--transform", nargs="+", action="append", default=[], metavar="STEP", help="identity | blur R | crop X0 Y0 X1 Y1 | resize SX SY | rotate DEGREES; may be repeated")
    run.add_argument("--tile-size", type=int, default=RunConfig.tile_size)
    run.add_argument("--halo", type=int, default=RunConfig.halo)
    run.add_argument("--border", choices=("zero", "clamp", "reflect"), default=RunConfig.border)
    run.add_argument("--threads", type=int, default=0, help="local threads; 0 takes the session's master")
    run.add_argument("--in-flight", type=int, default=RunConfig.in_flight, help="accepted; Spark schedules tasks")
    run.add_argument("--gpu", action="store_true", help="label tiles as if a device were there")
    for name, default in (("--gpu-tile-size", 1024), ("--cpu-tile-size", 512), ("--streams", 3)):
        run.add_argument(name, type=int, default=default, help="accepted; no device is driven")
    make = commands.add_parser("generate", help="write a checkerboard image")
    make.add_argument("width", type=int, nargs="?", default=4096)
    make.add_argument("height", type=int, nargs="?", default=4096)
    make.add_argument("--gray", action="store_true")
    make.add_argument("--tile", type=int, default=256)
    make.add_argument("--block", type=int, default=128)
    make.add_argument("--out", default="test_image.tiff")
    return top


def one_run(spark: SparkSession, tiles: DataFrame, info: RasterInfo, chain: Chain, config: RunConfig, mode: str, output: str) -> DataFrame:
    """Run, write, and return the stats row. The time is that of the chain and its mosaic, the file's is not in it."""
    columns, rows = grid_size(info.width, info.height, config.tile_size)
    one_task = mode == "sequential"
    if one_task:
        tiles = tiles.coalesce(1)
    seen = Observation()
    began = time.monotonic()
    done = run_on_tiles(tiles, info, chain, config, one_task).observe(seen, F.count(F.lit(1)).alias("written"))
    canvas = tile_ops.canvas_tiles(done, info, config.tile_size, one_task).cache()
    canvas.count()
    seconds = time.monotonic() - began
    written = seen.get["written"]
    tiff.write_tiff(canvas, info, output)
    canvas.unpersist()
    counters = (columns * rows, written, columns * rows - written, written)
    rate = info.width * info.height / 1e6 / seconds if seconds > 0 else 0.0
    return spark.createDataFrame([(mode, *counters, seconds, rate)], metrics.STATS)


def run(args: argparse.Namespace) -> None:
    chain = Chain.parse(" | ".join(" ".join(t) for t in args.transform))
    size = args.cpu_tile_size if args.mode.startswith("hetero") else args.tile_size
    config = RunConfig(size, args.halo, args.border, args.threads, args.in_flight, args.mode)
    chain.check()
    builder = SparkSession.builder.appName("rasterloom")
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    tiles, info = tiff.read_tiff(spark, args.input, config.tile_size, "image")
    stats = []
    if args.mode in ("sequential", "both"):
        stats.append(one_run(spark, tiles, info, chain, config, "sequential", f"{args.output}.seq.tiff" if args.mode == "both" else args.output))
    if args.mode == "hetero-bench":
        stats.append(one_run(spark, tiles, info, chain, config, "sequential", f"{args.output}.cpu.tiff"))
    if args.mode.startswith("hetero"):
        boxes = tile_grid(spark, info, config.tile_size).select("*", F.lit(effective_halo(chain, config)).alias("halo"), F.lit(info.channels).alias("channels"))
        routing.route_summary(routing.route_tiles(boxes, chain, routing.SchedulerConfig(gpu_available=args.gpu))).show(truncate=False)
    if args.mode != "sequential":
        stats.append(one_run(spark, tiles, info, chain, config, "parallel", args.output))
    runs = stats[0] if len(stats) == 1 else stats[0].unionByName(stats[1])
    runs.show(truncate=False)
    if len(stats) == 2:
        metrics.speedup(runs, args.threads or spark.sparkContext.defaultParallelism).show(truncate=False)


def generate(args: argparse.Namespace) -> None:
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    pixels, info = synthetic.checkerboard(spark, args.width, args.height, args.gray, args.block)
    tiff.write_tiff(tile_ops.tiles_from_pixels(pixels, info, args.tile), info, args.out)


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        if args.command == "run":
            Chain.parse(" | ".join(" ".join(t) for t in args.transform)).check()
    except SystemExit as stop:
        if stop.code not in (0, None):
            print(stop.code, file=sys.stderr)
        return 0 if stop.code in (0, None) else 1
    except ValueError as bad:
        print(bad, file=sys.stderr)
        return 1
    try:
        {"run": run, "generate": generate}[args.command](args)
    except Exception as failure:
        print(f"error: {failure}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
