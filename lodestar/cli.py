"""Command line: one JSON document on standard output, exit code 0 or 1."""

from __future__ import annotations

import argparse
import json
import os
import sys

from lodestar.service import Busy, Engine
from lodestar.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("--home", default=os.path.expanduser("~/.lodestar"))
    p.add_argument("--pretty", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("search")
    q.add_argument("collection")
    q.add_argument("query")
    q.add_argument("--top-k", type=int, default=5)
    q.add_argument("--rerank-candidates", type=int, default=50)
    q.add_argument("--probes", type=int, help="cells of the index to search; without it the search is exact")
    q.add_argument("--weights", type=float, nargs=2, metavar=("DENSE", "SPARSE"), help="weigh the two lists in the fusion")
    kb = sub.add_parser("kb").add_subparsers(dest="action", required=True)
    for action in ("add", "update", "remove", "list"):
        k = kb.add_parser(action)
        if action != "list":
            k.add_argument("name")
        if action == "add":
            k.add_argument("folder")
        if action in ("add", "update"):
            k.add_argument("--ignore", "--ignore-pattern", dest="ignore_pattern", action="append", default=[])
            k.add_argument("--ignore-ext", "--ignore-extension", dest="ignore_extension", action="append", default=[])
        if action == "update":
            k.add_argument("--clear-ignore", "--clear-patterns", dest="clear_patterns", action="store_true")
            k.add_argument("--clear-ignore-ext", "--clear-extensions", dest="clear_extensions", action="store_true")
    c = sub.add_parser("collection").add_subparsers(dest="action", required=True)
    for action in ("status", "sync", "rebuild", "tasks", "index", "clean"):
        c.add_parser(action).add_argument("name")
    sub.add_parser("health")
    return p


def run(engine: Engine, args: argparse.Namespace):
    rows = lambda df: [r.asDict() for r in df.collect()]
    match args.command, getattr(args, "action", None):
        case "search", _:
            more = {} if args.probes is None else {"probes": args.probes}
            if args.weights:
                more |= {"fusion": "weighted", "w_dense": args.weights[0], "w_sparse": args.weights[1]}
            return {"results": engine.search(args.collection, args.query, top_k=args.top_k, rerank_candidates=args.rerank_candidates, **more)}
        case "kb", "add":
            return {"name": args.name} | engine.add(args.name, args.folder, args.ignore_pattern, args.ignore_extension)
        case "kb", "update":  # an empty list leaves the rules as they are
            return engine.update(args.name, ignore_patterns=args.ignore_pattern or None, ignore_extensions=args.ignore_extension or None, clear_patterns=args.clear_patterns, clear_extensions=args.clear_extensions)
        case "kb", "remove":
            engine.remove(args.name)
            return {"removed": args.name}
        case "kb", "list":
            return {"collections": engine.catalog.all()}
        case "collection", "status":
            return rows(engine.status(args.name))[0]
        case "collection", "index":
            engine.build_index(args.name)
            return {"indexed": args.name}
        case "collection", "clean":
            engine.clean(args.name)
            return {"cleaned": args.name}
        case "collection", "sync":
            return engine.sync(args.name)
        case "collection", "rebuild":
            return engine.rebuild(args.name)
        case "collection", "tasks":
            return engine.tasks(args.name)
        case _:
            return {"collections": rows(engine.health())}


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    args = _parser().parse_args(argv)
    show = lambda value: print(json.dumps(value, ensure_ascii=False, indent=2 if args.pretty else None))
    try:
        show(run(engine or Engine(session(), args.home), args))
        return 0
    except (ValueError, KeyError, Busy) as e:
        show({"error": str(e.args[0] if e.args else e)})
        return 1


if __name__ == "__main__":
    sys.exit(main())
