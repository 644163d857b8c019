"""Command line: thin calls of the library. ``python -m typeloom.cli --help``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from typeloom import config
from typeloom.plans import extraction, registry
from typeloom.sources import layout, validation
from typeloom.sources.typing_logs import DatasetError, write_long


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("typeloom").getOrCreate()


def list_features(_: argparse.Namespace) -> int:
    print("\n".join(sorted(registry.names())))
    return 0


def extract(args: argparse.Namespace) -> int:
    settings = config.load(args.config) if args.config else config.DEFAULTS
    found, logs = extraction.from_logs(session(), args.data_root, settings=settings, only=args.features, without=args.exclude_features)
    try:
        long = found.long.persist()
        write_long(long, args.out)
        print(f"{long.count()} rows in {args.out}")
        for title, table, n in (("not typed by hand", found.dropped, "n_dropped"), ("fewer keydowns than the sanity minimum", found.short, "n_short"), ("failed", found.errors, "n_errors")):
            for r in table.collect():  # a row a session and version, or a feature
                print(f"{title}: {r.asDict()}")
        long.unpersist()
    finally:
        logs.release()
    return 0


def validate(args: argparse.Namespace) -> int:
    spark = session()
    validation.session_states(spark, args.data_root).orderBy("user").show(args.rows, truncate=False)
    validation.environment_changes(spark, args.data_root).orderBy("user", "session").show(args.rows, truncate=False)
    problems = validation.objections(spark, args.data_root)
    problems.orderBy("user", "session", "kind", "place").show(args.rows, truncate=False)
    return 0 if problems.isEmpty() else 1


def normalize(args: argparse.Namespace) -> int:
    for root in args.roots:  # all are planned before any is changed
        layout.plan(root)
    for root in args.roots:
        moves = layout.normalize(root, args.apply)
        print(f"{root}: {len(moves)} moves ({'made' if args.apply else 'dry run'})")
    return 0


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="typeloom", description=__doc__)
    commands = whole.add_subparsers(required=True)
    commands.add_parser("list-features", help="names of all registered features").set_defaults(run=list_features)

    one = commands.add_parser("extract", help="raw logs to a long table of features")
    one.add_argument("--data-root", required=True)
    one.add_argument("--out", required=True)
    one.add_argument("--config", help="settings, YAML or JSON")
    either = one.add_mutually_exclusive_group()
    either.add_argument("--features", nargs="+", help="only these")
    either.add_argument("--exclude-features", nargs="+", help="all but these")
    one.set_defaults(run=extract)

    check = commands.add_parser("validate", help="strict validation of raw logs")
    check.add_argument("--data-root", required=True)
    check.add_argument("--rows", type=int, default=200, help="rows shown of each report")
    check.set_defaults(run=validate)

    move = commands.add_parser("normalize", help="canonical names of folders and files; a dry run unless --apply")
    move.add_argument("roots", nargs="+")
    move.add_argument("--apply", action="store_true")
    move.set_defaults(run=normalize)
    return whole


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (DatasetError, config.ConfigError, ValueError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
