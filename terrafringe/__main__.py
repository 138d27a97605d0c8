"""Commands over Parquet tables: `python -m terrafringe misclosure PHASES OUT --least-days 12`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from terrafringe.plans import workflows as W


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terrafringe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("source")
        sub.add_argument("out")
        for flag, more in options:
            sub.add_argument(flag, **more)

    command("extract", ("--window", {"type": int, "nargs": 4}), ("--mask", {}), ("--looks", {"type": int, "default": 1}), ("--merge", {"default": "mean", "choices": ["mean", "median", "min", "max"]}))
    command("misclosure", ("--start", {}), ("--end", {}), ("--exclude", {}), ("--least-days", {"type": int}), ("--most-days", {"type": int}), ("--reference", {"type": int, "nargs": 2}))
    command("assist", ("--beam", {"default": "IW"}), ("--start", {}), ("--end", {}), ("--south", {"type": float}), ("--north", {"type": float}))
    command("search", ("--track", {"type": int}), ("--direction", {}), ("--version", {}), ("--start", {}), ("--end", {}), ("--most", {"type": int, "default": 250}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    rows = spark.read.parquet(args.source)
    if args.command == "extract":
        out = W.extract(rows, W.Window(*args.window) if args.window else None, spark.read.parquet(args.mask) if args.mask else None, args.looks, args.merge)
    elif args.command == "misclosure":
        out = W.misclosure(rows, args.start, args.end, spark.read.parquet(args.exclude) if args.exclude else None, args.least_days, args.most_days, tuple(args.reference) if args.reference else None)
    elif args.command == "assist":
        out = W.area_assist(rows, beam=args.beam, start=args.start, end=args.end, south=args.south, north=args.north)
    else:
        out = W.scene_search(rows, args.track, args.direction, args.version, start=args.start, end=args.end, most=args.most)
    out.write.mode("errorifexists").parquet(args.out)


if __name__ == "__main__":
    main()
