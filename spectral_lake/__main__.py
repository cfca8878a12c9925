"""python -m spectral_lake convert: convert a file; check-terms: validate vocabulary; describe: print metadata."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import logs
from .config import SETTINGS
from .convert import convert
from .operators import ontology
from .sinks import lake
from .sources.extraction import Extraction


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spectral_lake")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format", default=SETTINGS.output_format, help="a registered output format")
    c.add_argument("--dataset-id", default=SETTINGS.dataset_id)
    c.add_argument("--pixel-size", type=float)
    c.add_argument("--handle-3d", action="store_true")
    c.add_argument("--optimize-chunks", action="store_true", help="store pixels of one tile together")
    t = sub.add_parser("check-terms")
    t.add_argument("input", help="a file, or a folder that is searched whole")
    t.add_argument("terms", nargs="+", help="OBO files; a later one replaces terms of those before it")
    t.add_argument("--output", help="a JSON report")
    t.add_argument("--verbose", action="store_true", help="list every unknown term")
    d = sub.add_parser("describe")
    d.add_argument("input")
    for x in (c, t, d):
        x.add_argument("--log-level", default="INFO")
        x.add_argument("--log-file")
    return p


def describe(spark: SparkSession, path: str) -> dict:
    """Essential metadata and the sections of a file, as a document."""
    return Extraction(spark, path).comprehensive()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logs.setup(args.log_level, args.log_file)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "convert":
        done = convert(spark, args.input, args.output, args.dataset_id, args.pixel_size, args.handle_3d, output_format=args.format)
        if done and args.optimize_chunks:
            done = lake.optimise(args.output)
        return 0 if done else 1
    if args.command == "describe":
        json.dump(describe(spark, args.input), sys.stdout, indent=2, default=str)
        return 0
    params, terms = ontology.read_params(spark, args.input), ontology.load_vocabularies(spark, args.terms)
    print(ontology.report(params, terms, shown=1 << 30 if args.verbose else 10))
    found = ontology.results(params, terms)
    if args.output:
        with open(args.output, "w") as f:
            json.dump(found, f, indent=2, default=str)
    return 0 if not found["unknown_terms"] else 1


def convert_main() -> int:
    return main(["convert", *sys.argv[1:]])


def check_main() -> int:
    return main(["check-terms", *sys.argv[1:]])


if __name__ == "__main__":
    raise SystemExit(main())
