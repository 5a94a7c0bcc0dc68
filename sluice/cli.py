"""``python -m sluice.cli CONTROL [-i INPUT] [-O OUTPUT] [-l LOG] [-P PARSE_BAD] [-u DUP_BAD] [-o KEY=VALUE]... [--reports FOLDER] --columns SPEC``"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans.load import load
from .plans.options import parse_control, with_paths
from .plans.spec import spec_of

#: Exit codes (fixed values): the load failed, no session, something wrong with what was given (also: records were rejected), anything else.
COMMAND, CONNECTION, USER, OTHER = 1, 2, 3, 4


def pairs_of(args: argparse.Namespace) -> list[tuple[str, str]]:
    """The control file's options, then those of the command line; file names are relative to where each stands."""
    pairs = []
    if args.control:
        with open(args.control) as file:
            pairs = with_paths(parse_control(file.read()), os.path.dirname(os.path.abspath(args.control)))
    given = [tuple(x.split("=", 1)) for x in args.option]
    names = (("INPUT", args.input), ("OUTPUT", args.output), ("LOGFILE", args.logfile), ("PARSE_BADFILE", args.parse_badfile), ("DUPLICATE_BADFILE", args.duplicate_badfile))
    given += [(k, v) for k, v in names if v]
    return pairs + with_paths(pairs + given, os.getcwd())[len(pairs) :]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice", description="Load a file into a table, with checks.")
    p.add_argument("control", nargs="?")
    p.add_argument("-i", "--input")
    p.add_argument("-O", "--output")
    p.add_argument("-l", "--logfile")
    p.add_argument("-P", "--parse-badfile")
    p.add_argument("-u", "--duplicate-badfile")
    p.add_argument("-o", "--option", action="append", default=[])
    p.add_argument("--columns", required=True, help="name type [not null], ...")
    p.add_argument("--reports", default="sluice_reports", help="folder of log and reject files that have no name of their own")
    args = p.parse_args(argv)
    def failed(e: Exception, code: int) -> int:
        print(f"error: {e}", file=sys.stderr)
        return code

    try:
        given, spec = pairs_of(args), spec_of(args.columns)
    except Exception as e:
        return failed(e, USER if isinstance(e, ValueError) else OTHER)
    try:
        spark = SparkSession.builder.getOrCreate()
    except Exception as e:
        return failed(e, CONNECTION)
    try:
        result = load(spark, given, spec, reports=args.reports)
    except Exception as e:
        return failed(e, COMMAND)
    for k in ("skip", "count", "parse_errors", "duplicate_new", "duplicate_old"):
        print(f"{getattr(result, k):>12} {k}")
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
