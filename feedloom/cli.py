"""Command line: python -m feedloom.cli [options] [URL ...]"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from typing import TextIO

LOOK_BACK_DAYS = 7
LONGEST_LINE = 1 << 20


def addresses(argv: list[str], stdin: TextIO | None) -> list[str]:
    """Positional addresses first, then lines of standard input unless it is a terminal; blanks go, repeats stay."""
    out = list(argv)
    if stdin is not None and not stdin.isatty():
        for line in stdin:
            if len(line) > LONGEST_LINE:
                raise ValueError("a line of standard input is too long")
            if line.strip():
                out.append(line.strip())
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="feedloom", description="Items of syndication feeds as JSON Lines.")
    p.add_argument("--version", action="store_true")
    p.add_argument("--since", default="")
    p.add_argument("--until", default="")
    p.add_argument("--all", action="store_true")
    p.add_argument("--updated", action="store_true")
    p.add_argument("--jq", default="")
    p.add_argument("-r", dest="raw", action="store_true")
    p.add_argument("--with-feed", action="store_true")
    p.add_argument("--max-pages", type=int, default=10)
    p.add_argument("urls", nargs="*")
    return p


def job(args: argparse.Namespace, now: dt.datetime | None = None, zone: str | None = None):
    """The reading job the flags describe; ValueError where they contradict each other.  Dates are days of this machine's zone if none is given."""
    from feedloom.plans.reader import FeedJob

    since = args.since
    if args.all and (args.since or args.until):
        raise ValueError("--all leaves no room for --since or --until")
    if not since and not args.until and not args.all:
        since = ((now or dt.datetime.now(dt.timezone.utc)) - dt.timedelta(days=LOOK_BACK_DAYS)).isoformat()
        since = since.replace("+00:00", "Z")
    if args.updated and not since and not args.until:
        raise ValueError("--updated needs a period: --since or --until")
    return FeedJob(since=since, until=args.until, prefer_updated=args.updated, max_pages=args.max_pages, jq=args.jq, raw=args.raw, with_feed=args.with_feed, zone=zone)


def main(argv: list[str] | None = None, stdin: TextIO | None = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr, spark=None, **options: str) -> int:
    args = parser().parse_args(argv)
    if args.version:
        print("feedloom 1.0", file=out)
        return 0
    try:
        todo = addresses(args.urls, stdin)
        if not todo:
            raise ValueError("no address of a feed or site was given")
        plan = job(args)
        if spark is None:
            from feedloom.session import local_session

            spark = local_session(8)
        for line in plan.run(spark, todo, **options):
            print(line, file=out)
    except Exception as e:  # noqa: BLE001
        print(f"feedloom: {e}", file=err)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
