"""Command line: ``python -m helixspark.cli INPUT --output OUT [--metadata FILE] ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from helixspark.plans import config as cfg
from helixspark.plans import phases


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixspark", description="Compare sequencing samples by their k-mers.")
    p.add_argument("input", help="folder of FASTQ files")
    p.add_argument("--output", "-o", default="helixspark_results")
    p.add_argument("--metadata", "-m", help="CSV or TSV of sample attributes")
    p.add_argument("--config", help="JSON or YAML settings")
    p.add_argument("--preset", choices=list(cfg.PRESETS))
    p.add_argument("--sample-id-column")
    p.add_argument("--kmer-size", "-k", type=int, dest="k")
    p.add_argument("--max-reads", type=int)
    p.add_argument("--min-kmer-freq", type=int)
    p.add_argument("--sketch", action="store_const", const=True)
    p.add_argument("--sketch-size", type=int)
    p.add_argument("--sampling", choices=cfg.SAMPLING)
    p.add_argument("--metric", choices=cfg.METRICS)
    p.add_argument("--threshold", type=float)
    p.add_argument("--permutations", type=int)
    p.add_argument("--min-clusters", type=int)
    p.add_argument("--max-clusters", type=int)
    p.add_argument("--variables", nargs="+")
    p.add_argument("--variant", choices=("standard", "simple"))
    p.add_argument("--max-group-size", type=int)
    p.add_argument("--tools", nargs="+")
    return p


def settings(args: argparse.Namespace) -> cfg.Config:
    base = cfg.load(args.config) if args.config else cfg.preset(args.preset) if args.preset else cfg.from_environment()
    names = {"input", "output", "metadata", "config", "preset"}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if k not in names and v is not None}
    return base.updated(**given).checked()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = settings(args)
        spark = SparkSession.builder.appName("helixspark").getOrCreate()
        tables = phases.run(spark, args.input, args.output, config, args.metadata)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    tables["overall"].show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
