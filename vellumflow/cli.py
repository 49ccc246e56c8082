"""Commands: ``analyze CONFIG`` runs a project, ``check FILES`` tells what a policy would object to in PDF files."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from pathlib import Path

from vellumflow.sources.config import STRATEGIES


def _list_models(args: argparse.Namespace) -> int:
    from vellumflow.session import build_session
    from vellumflow.sources.pricing import load_prices, model_listing

    spark = build_session("vellumflow")
    prices, _ = load_prices(spark, args.list_models)
    models = json.loads(Path(args.list_models).read_text(encoding="utf-8"))["models"]
    rows = [(name, m.get("input_token_limit"), m.get("output_token_limit")) for name, m in models.items()]
    for r in model_listing(spark.createDataFrame(rows, "model_name string, input_token_limit long, output_token_limit long"), prices).toLocalIterator():
        print(r.model_name, f"in {r.input_limit} at {r.input_price}", f"out {r.output_limit} at {r.output_price}", sep="\t")
    return 0


def _analyze(args: argparse.Namespace) -> int:
    if args.list_models:
        return _list_models(args)
    if not args.config:
        print("a configuration is required", file=sys.stderr)
        return 2
    from vellumflow.plans.project import run_project
    from vellumflow.session import build_session
    from vellumflow.sources.config import ProjectConfig
    from vellumflow.sources.normalise import Normaliser

    config = ProjectConfig.from_path(args.config)
    if args.model:
        config.model = args.model
    if args.oversize_strategy:
        config.oversize_strategy = args.oversize_strategy
    workers = args.workers or config.workers
    spark = build_session("vellumflow", f"local[{workers}]" if workers else None)
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    tidy = Normaliser(args.flattener, args.converter, args.validator, config.flatten_dpi)
    figures = run_project(spark, config, force=args.force, offline=args.offline, limit=args.limit, normalise=lambda path: tidy(path, config.flatten_pdf))
    for key, value in figures.items():
        print(f"{key}: {value}")
    return 0


def _check(args: argparse.Namespace) -> int:
    from vellumflow.sources.normalise import Normaliser
    from vellumflow.sources.pdf import PdfError

    failed, tidy = False, Normaliser(args.flattener, args.converter, args.validator, args.flatten_dpi)
    for name in args.files:
        path = Path(name)
        try:
            print(f"{path}: {', '.join(tidy.issues(path))}")
            if args.sanitise or args.flatten:
                left = tidy(path, args.flatten)
                if args.verbose:
                    print(f"{path}: now {', '.join(left)}")
        except (OSError, PdfError, subprocess.CalledProcessError) as e:
            failed = True
            print(f"{path}: {e}", file=sys.stderr)
    return int(failed)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellumflow")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="run a project")
    a.add_argument("config", nargs="?")
    a.add_argument("--model")
    a.add_argument("--workers", type=int)
    a.add_argument("--limit", type=int)
    a.add_argument("--force", action="store_true")
    a.add_argument("--offline", action="store_true", help="report only, extract nothing")
    a.add_argument("--list-models", metavar="SNAPSHOT", help="list the models of a price snapshot and stop")
    a.add_argument("--oversize-strategy", choices=STRATEGIES, help="what to do with files above the upload limit")
    a.set_defaults(run=_analyze)
    c = commands.add_parser("check", help="list what a policy objects to in PDF files")
    c.add_argument("files", nargs="+")
    c.add_argument("--sanitise", action="store_true", help="rewrite the files without it")
    c.add_argument("--flatten", action="store_true", help="flatten the pages to images first")
    c.add_argument("--flatten-dpi", type=int, default=300)
    c.set_defaults(run=_check)
    for x in (a, c):
        x.add_argument("--verbose", action="store_true")
        x.add_argument("--validator", help="outside tool that judges conformity")
        x.add_argument("--converter", help="outside tool that makes files conform")
        x.add_argument("--flattener", help="outside tool that flattens pages")
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
