"""Compare two generations of a feed from the command line: ``python -m gantline compare OLD NEW --out DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.diff import count_by
from .plans import calendars, digest, identity, presentation, report
from .plans.compare import Comparison, compare
from .sources import generations
from .sources.config import load
from .sources.feed import Feed, FeedError, read_feed
from .sources.scratch import Scratch


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gantline", description="What changed between two generations of a feed of schedule tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, says in (("compare", "explain all differences"), ("identity", "tell how much of each kind was found again"), ("check", "read two generations and count their rows")):
        command = commands.add_parser(name, help=says)
        command.add_argument("inputs", nargs="*", metavar="OLD NEW", help="two zip files or folders, the older first")
        command.add_argument("--folder", help="a folder of zip files named current, prev_1 and so on, in place of OLD NEW")
        command.add_argument("--old", default="prev_1", help="older generation in the folder")
        command.add_argument("--new", default="current", help="newer generation in the folder")
        command.add_argument("--config", help="a TOML file with thresholds")
        command.add_argument("--out", help="folder for compressed JSON lines, one folder for each table")
        if name == "compare":
            command.add_argument("--markdown", action="store_true", help="print the report")
            command.add_argument("--group", help="print the events of one route group")
            command.add_argument("--digest", action="store_true", help="print what changed in few words")
            command.add_argument("--page", help="print the changed trips of one page")
    return parser


def inputs(spark: SparkSession, args: argparse.Namespace) -> tuple[str, str]:
    if args.folder:
        return generations.pair(generations.in_folder(spark, args.folder), args.old, args.new)
    if len(args.inputs) != 2:
        raise FeedError("give two feeds, the older first, or --folder")
    return args.inputs[0], args.inputs[1]


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def say(rows: DataFrame, most: int = 200) -> None:
    """A table of at most so many rows."""
    print("\t".join(rows.columns))
    for row in rows.limit(most).collect():
        print("\t".join("" if v is None else str(v) for v in row))


def tell(result: Comparison, args: argparse.Namespace, old: Feed, new: Feed, scratch: Scratch) -> None:
    say(count_by(result.diffs, "file").orderBy("file"))
    total, explained, ratio = result.explained().first()
    print(f"{result.events.count()} events; {explained} of {total} differences explained ({ratio:.4f})")
    if args.markdown:
        print(report.markdown(result, result.config["report"]["digest_routes_max"]))
    if args.group:
        say(report.group_events(result, args.group))
    if args.digest or args.page:
        conf = result.config["report"]
        found = digest.build(result, presentation.build(result, scratch), old, new, scratch)
        if args.digest:
            print(digest.markdown(found, conf["digest_routes_max"], conf["digest_stops_max"]))
        if args.page:
            try:
                print(digest.route_markdown(result, found, args.page))
            except KeyError as e:
                raise FeedError(e.args[0]) from e
        if args.out:
            digest.write(found, f"{args.out}/digest")
    if args.out:
        report.write(result, args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gantline").getOrCreate()
    config = load(args.config)
    scratch = Scratch(spark, "gantline")
    try:
        old, new = (read_feed(spark, path, scratch) for path in inputs(spark, args))
        if args.command == "compare":
            tell(compare(old, new, config, scratch), args, old, new, scratch)
        elif args.command == "identity":
            types = [scratch.put(calendars.day_types(f, config), "day-types") for f in (old, new)]
            figures = scratch.put(identity.statistics(identity.build(old, new, *types, config, scratch), config["events"]["accept_confidence"]), "statistics")
            say(figures)
            if args.out:
                write({"statistics": figures}, args.out)
        else:
            for feed in (old, new):
                say(digest.row_counts(feed))
                say(count_by(calendars.day_types(feed, config), "day_type").orderBy("day_type"))
    except FeedError as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        scratch.clear()
    return 0


if __name__ == "__main__":
    sys.exit(main())
