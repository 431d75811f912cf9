"""Command line: a SQLite library in, CSV files and a text report out.  Exit codes: 0, 2 if
the file isn't there, 3 if it can't be read."""

from __future__ import annotations

import argparse
import sqlite3
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from playlog.config import EngineConfig
from playlog.plans import artefacts as A
from playlog.plans.catalogue import Analyses
from playlog.sources.sqlite import SqliteLibrary


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    d = EngineConfig()
    p = argparse.ArgumentParser(prog="playlog", description="Analyses of a music library's listening history.")
    p.add_argument("database", type=Path)
    p.add_argument("-o", "--output", type=Path, default=Path("playlog_report"))
    p.add_argument("--user", help="id or name; all users if left out")
    p.add_argument("--top", type=int, default=d.top)
    p.add_argument("--session-gap", type=int, default=d.session_gap, help="minutes")
    p.add_argument("--pair-window", type=int, default=d.pair_window, help="minutes")
    p.add_argument("--resurrection-days", type=int, default=d.resurrection_days)
    p.add_argument("--album-complete", type=float, default=d.album_complete)
    p.add_argument("--album-thread-hours", type=float, default=d.thread_hours)
    p.add_argument("--resume-slack", type=int, default=d.resume_slack)
    p.add_argument("--inspect", action="store_true", help="also write schema.txt")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    path = args.database.expanduser().resolve()
    if not path.exists():
        print(f"not found: {path}", file=sys.stderr)
        return 2
    args.output.mkdir(parents=True, exist_ok=True)
    config = EngineConfig(args.top, args.session_gap, args.pair_window, None, args.resurrection_days, args.album_complete, args.album_thread_hours, args.resume_slack)
    try:
        source = SqliteLibrary(spark, str(path), args.user)
    except sqlite3.DatabaseError as error:
        print(f"can't be read: {error}", file=sys.stderr)
        return 3
    if args.inspect:
        (args.output / "schema.txt").write_text(source.catalog.text() + "\n", encoding="utf-8")
    for user, name in source.user_names.items():
        print(f"user {name} [{user}]{' *' if source.selected and user in source.selected else ''}")
    library = source.library()
    a = Analyses(library, config, keep=True)
    A.export(a, ("album_metadata_issues",), args.output)
    A.write_csv(A.ordered("album_library_coverage", a.album_library_coverage(source.selected)), args.output / "album_library_coverage.csv")
    if source.source:
        print(f"play log: {source.source.table} ({source.source.media}, {source.source.time})")
        unknown = library.plays.join(a.enriched.select(F.col("id").alias("track_id")), "track_id", "left_anti").count()
        if unknown:
            print(f"{unknown} plays of unknown tracks are left out", file=sys.stderr)
        undatable = source.undatable()
        if undatable:
            print(f"{undatable} plays without a readable date are left out", file=sys.stderr)
        # what is compared with dated plays are the strict counters
        strict = a.with_annotations(source.annotations(strict=True))
        if not a.heard.isEmpty():
            A.export(strict, A.BASE, args.output)
        A.export(a, A.THREADS, args.output)
        text = A.history_text(strict, f"{source.source.table}.{source.source.time}") + A.threads_text(a) + A.library_text(a, True)
    else:
        print("no play log; accumulated counters only")
        A.export(a, ("legacy_playcounts",), args.output)
        text = A.legacy_text(a) + A.library_text(a, False)
    (args.output / "report.txt").write_text(text, encoding="utf-8")
    print(f"report: {args.output / 'report.txt'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("playlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
