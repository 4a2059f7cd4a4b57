"""python -m tidemill.cli scan|classify|report|apply|undo|purge|status SOURCE …

Exit codes: 0 done, 1 error, 2 usage, 3 locked, 4 refused roots, 5 done in part.
"""

from __future__ import annotations

import argparse
import json
import sys

from tidemill.functions.config import ClassifyConfig
from tidemill.functions.display import LANGUAGES
from tidemill.plans import workspace as W
from tidemill.plans.console import plan_lines
from tidemill.session import build_session
from tidemill.sources.catalog import Locked


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemill")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("scan", "classify", "report", "apply", "undo", "purge", "status"):
        own = commands.add_parser(name)
        own.add_argument("source")
        own.add_argument("--review")
        own.add_argument("--delete")
        own.add_argument("--no-subfolders", action="store_true")
        own.add_argument("--force-lock", action="store_true")
        own.add_argument("--master", default="local[*]")
        if name == "classify":
            for field in ("short_video_seconds", "similar_window_seconds", "blur_threshold", "dark_mean", "dark_p99"):
                own.add_argument("--" + field.replace("_", "-"), type=float)
            own.add_argument("--similar-distance", type=int)
            own.add_argument("--move-all-aae", action="store_true", default=None)
        if name == "report":
            own.add_argument("--out")
            own.add_argument("--json", action="store_true", help="print the report as JSON instead of a table")
            own.add_argument("--lang", choices=LANGUAGES, default="en")
            own.add_argument("--examples", type=int, default=5)
        if name in ("apply", "undo", "purge"):
            own.add_argument("--yes", action="store_true", help="carry out instead of a dry run")
        if name == "apply":
            own.add_argument("--category", action="append")
        if name == "undo":
            own.add_argument("--scope", choices=("last", "session", "category", "all"), default="last")
            own.add_argument("--session", type=int)
            own.add_argument("--category")
    return out


def run(args: argparse.Namespace, spark) -> tuple[object, int]:
    ws = W.open_workspace(spark, args.source, args.review, args.delete, recursive=not args.no_subfolders, read_only=args.command == "status", force_lock=args.force_lock)
    try:
        if args.command == "scan":
            out = W.run_scan(ws)
        elif args.command == "classify":
            fields = ("short_video_seconds", "similar_window_seconds", "blur_threshold", "dark_mean", "dark_p99", "similar_distance", "move_all_aae")
            cfg: ClassifyConfig = ws.catalog.config().with_overrides(**{f: getattr(args, f) for f in fields})
            out = W.run_classify(ws, cfg)
        elif args.command == "report":
            out = W.get_plan(ws, examples=max(args.examples, 12), lang=args.lang)
            if args.out:
                W.write_reports(ws, args.out, args.lang)
            if not args.json:
                return "\n".join(plan_lines(out, examples=args.examples, lang=args.lang)), 0
        elif args.command == "apply":
            out = W.run_apply(ws, args.category, dry_run=not args.yes)
        elif args.command == "undo":
            out = W.run_undo(ws, args.scope, session_id=args.session, category=args.category, dry_run=not args.yes)
        elif args.command == "purge":
            out = W.run_purge(ws, dry_run=not args.yes)
        else:
            out = W.status(ws)
        return out, 5 if isinstance(out, dict) and out.get("errors") else 0
    finally:
        ws.close()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out, code = run(args, build_session("tidemill", args.master))
    except Locked as error:
        print(error, file=sys.stderr)
        return 3
    except ValueError as error:
        print(error, file=sys.stderr)
        return 4
    except OSError as error:
        print(error, file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
