"""Command line: evaluate an expression on a JSON value, or fold one over JSON lines.

    python -m docloom.cli EXPR < value.json
    python -m docloom.cli -f lines.jsonl -e STEP [-st INIT] [-ed FINAL]
    python -m docloom.cli -s EXPR
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path
from typing import Any

from docloom.functions import rules
from docloom.functions.values import _jsonable, parse_json, string_of
from docloom.plans.rules.interpreter import Failure, Machine
from docloom.plans.rules.parser import parse_program, parse_text


def load(path: str) -> Any:
    return parse_text(Path(path).read_text())


def add_cli_functions() -> None:
    """Functions that only the command line has."""

    def read(m: Machine, path: Any) -> Any:
        try:
            return parse_json(Path(string_of(path)).read_text())
        except (OSError, ValueError) as e:
            raise Failure(str(e)) from e

    rules.register_function("read", read, 1, 1)
    rules.register_function("read_bytes", lambda m, path: Path(string_of(path)).read_bytes(), 1, 1)
    rules.register_function("import", lambda m, path: m.value(load(string_of(path))), 1, 1)


def show(value: Any) -> None:
    if value is not None:
        print(json.dumps(_jsonable(value), indent=2, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="docloom")
    args.add_argument("expression", nargs="?")
    args.add_argument("-f", "--file")
    args.add_argument("-e", "--each")
    args.add_argument("-st", "--start", default="")
    args.add_argument("-ed", "--end", default="")
    args.add_argument("-s", "--single")
    args.add_argument("-n", "--no-input", action="store_true")
    args.add_argument("--lib", default=os.path.expanduser("~/.explib"))
    got = args.parse_args(argv)
    add_cli_functions()
    machine = Machine()
    for path in sorted(Path(got.lib).glob("*")) if os.path.isdir(got.lib) else ():
        machine.run(load(str(path)))
    if got.single:
        show(machine.run(parse_text(got.single)))
    elif got.file:
        from pyspark.sql import SparkSession

        from docloom.operators.fold import fold
        from docloom.sources.json import read_lines

        spark = SparkSession.builder.getOrCreate()
        show(fold(read_lines(spark, got.file), "text", got.each or "nil", got.start, got.end, "line"))
    else:
        if not got.no_input:
            machine.vars["$"] = parse_json(sys.stdin.read())
        show(machine.run(parse_text(got.expression or "$")))
    if machine.error:
        print(machine.error, file=sys.stderr)
        return 1
    return 0


__all__ = ["main", "parse_program"]

if __name__ == "__main__":
    sys.exit(main())
