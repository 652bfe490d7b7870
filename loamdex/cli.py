"""Command line: init, index, query. Exit codes: 0 done, 1 failed, 2 wrong use, 3 done in part, 130 cancelled."""

from __future__ import annotations

import argparse
import os
import sys

from loamdex.sources.config import CONFIG_NAME, MODES, ConfigError, find_project, write_default


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="loamdex")
    sub = parser.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="write a settings file")
    init.add_argument("target", nargs="?", default=".")
    index = sub.add_parser("index", help="bring the index up to date")
    index.add_argument("target", nargs="?", default=".")
    index.add_argument("--dry-run", action="store_true")
    index.add_argument("--progress", action="store_true")
    index.add_argument("--json", action="store_true")
    query = sub.add_parser("query", help="ask the index")
    query.add_argument("text")
    query.add_argument("--mode", choices=MODES)
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--root", default=".")
    query.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "init":
            write_default(os.path.join(args.target, CONFIG_NAME))
            return 0
        return _run(args, spark)
    except (ConfigError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


def _run(args: argparse.Namespace, spark) -> int:
    from pyspark.sql import SparkSession

    from loamdex.functions.progress import duration_text
    from loamdex.plans.engine import Engine, QueryError, hit_text, result_json
    from loamdex.sources.storage import IndexAccessError, StorageFailure

    root, target, config = find_project(args.root if args.command == "query" else args.target)
    engine = Engine(spark or SparkSession.builder.appName("loamdex").getOrCreate(), root, config)
    for w in config.warnings:
        print(w, file=sys.stderr)
    try:
        if args.command == "query":
            result = engine.query(args.text, args.limit, args.mode)
            print(result_json(result) if args.json else "\n".join(map(hit_text, result.hits)) or "no hits")
            return 0
        if args.dry_run:
            print(result_json(engine.preview(target)))
            return 0
        done = engine.index(target, (lambda name, ms: print(name if ":" in name else f"{name}: done in {duration_text(ms / 1000)}", file=sys.stderr)) if args.progress else None)
        print(result_json(done) if args.json else f"{done.status}: {done.counts}, {done.chunks} chunks, {done.deleted} deleted, {done.issue_count} issues")
        return {"COMPLETE": 0, "PARTIAL": 3, "CANCELLED": 130}.get(done.status, 1)
    except QueryError as e:
        print(e.reason, file=sys.stderr)
        return 2
    except (IndexAccessError, StorageFailure) as e:
        print(f"{e.reason}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
