"""Command line: digitise the images at a path and write a CSV for each."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tracegrid.config import AxisCalibration, CalibrationPoint, DigitizeOptions
from tracegrid.plans import api


def pair(text: str) -> tuple[float, float]:
    """Two numbers with a comma between them."""
    parts = text.split(",")
    if len(parts) != 2:
        raise argparse.ArgumentTypeError(f"not x,y: {text!r}")
    return float(parts[0]), float(parts[1])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracegrid", description="Read numeric curves from images of charts.")
    p.add_argument("image", help="an image, a folder or a pattern that Spark can read")
    p.add_argument("--out", required=True, help="folder for the CSV files, one an image")
    for name in ("xmin", "xmax", "ymin", "ymax"):
        p.add_argument(f"--{name}", type=float)
    for point in ("origin", "x", "y"):
        for kind in ("px", "data"):
            p.add_argument(f"--{point}-{kind}", type=pair, metavar="X,Y")
    p.add_argument("--k", type=int, default=100)
    p.add_argument("--num-colors", type=int, default=0)
    for flag in ("auto-colors", "exclude-grayscale", "monotone-y", "xscale-log", "yscale-log", "keep-outside-axes", "marked-corners", "engine-csv"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def calibration(args: argparse.Namespace) -> AxisCalibration | None:
    """The calibration by hand, if all six pairs are given; None if none is."""
    given = {f"{a}_{b}": getattr(args, f"{a}_{b}") for a in ("origin", "x", "y") for b in ("px", "data")}
    missing = [k for k, v in given.items() if v is None]
    if len(missing) == len(given):
        return None
    if missing:
        raise SystemExit("a calibration by hand needs all of " + ", ".join("--" + k.replace("_", "-") for k in given))
    return AxisCalibration(*[CalibrationPoint(given[f"{p}_px"], given[f"{p}_data"]) for p in ("origin", "x", "y")])


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> api.DigitizeResult:
    args = parser().parse_args(argv)
    by_hand = calibration(args)
    names = ("k", "auto_colors", "num_colors", "exclude_grayscale", "monotone_y", "xscale_log", "yscale_log", "keep_outside_axes")
    options = DigitizeOptions(**{n: getattr(args, n) for n in names})
    spark = spark or SparkSession.builder.appName("tracegrid").getOrCreate()
    limits = {n: getattr(args, n) for n in ("xmin", "xmax", "ymin", "ymax")}
    if args.marked_corners:
        result = api.digitize_marked(spark, args.image, **limits, options=options)
    else:
        result = api.digitize(spark, args.image, by_hand, **limits, options=options)
    (result.to_engine_csv if args.engine_csv else result.to_csv)(args.out)
    for row in result.warnings.toLocalIterator():
        print(f"warning: {row['image_id']}: {row['warning']}")
    print(f"wrote {args.out}")
    return result


if __name__ == "__main__":
    main()
