"""Command lines: run a parameter file, precompute its kernels, validate it, or convert an older kernel cache."""

from __future__ import annotations

import argparse
import json
import logging

import yaml
from pyspark.sql import SparkSession

from . import run as engine
from .config import Report
from .sources import kernels


def load(path: str) -> dict:
    with open(path) as f:
        return yaml.safe_load(f)


def _session() -> SparkSession:
    return SparkSession.builder.appName("harmonia").getOrCreate()


def _parser(what: str, name: str = "parameters") -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=what)
    p.add_argument(name, nargs="?")
    p.add_argument("--parameter-file", "-p", dest="file")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--quiet", "-q", action="store_true")
    return p


def _read(p: argparse.ArgumentParser, argv: list[str] | None) -> tuple[argparse.Namespace, dict]:
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.WARNING if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    path = a.file or a.parameters
    if not path:
        p.error("a parameter file is needed")
    return a, load(path)


def validate(argv: list[str] | None = None) -> int:
    p = _parser("check a parameter file")
    p.add_argument("--strict", action="store_true", help="warnings fail too")
    a, params = _read(p, argv)
    report = Report(params)
    print(report.text())
    return int(not report.ok or a.strict and bool(report.warnings))


def precompute(argv: list[str] | None = None) -> int:
    p = _parser("compute the kernels that a run needs")
    p.add_argument("--dryrun", action="store_true", help="only say which")
    a, params = _read(p, argv)
    spark = _session()
    if a.dryrun:
        print(engine.kernel_folder(params), engine.kernel_pairs(spark, engine.Config.of(params)))
    else:
        print(engine.precompute(spark, params))
    return 0


def convert(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="bring kernel files of an older cache into a kernel folder")
    p.add_argument("old")
    p.add_argument("folder")
    p.add_argument("--identity", default="{}", help="what the kernels were made for, as JSON")
    a = p.parse_args(argv)
    print(kernels.convert(_session(), a.old, a.folder, json.loads(a.identity)))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = _parser("compute a covariance matrix")
    p.add_argument("--overwrite", type=int, help="write into this version")
    p.add_argument("--save-windows", action="store_true")
    p.add_argument("--dryrun", action="store_true", help="resolve everything, compute no covariance")
    a, params = _read(p, argv)
    print(engine.run(_session(), params, overwrite=a.overwrite, windows=a.save_windows, dry=a.dryrun))
    return 0


COMMANDS = {"run": main, "precompute": precompute, "validate": validate, "convert": convert}


def entry(argv: list[str]) -> int:
    """``run`` unless the first word is a command."""
    if argv and argv[0] in COMMANDS:
        return COMMANDS[argv[0]](argv[1:])
    return main(argv)


if __name__ == "__main__":
    import sys

    raise SystemExit(entry(sys.argv[1:]))
