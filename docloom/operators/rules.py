"""Rule programs over the columns of a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import rules as _functions
from docloom.functions.values import Flags, dump_json, plain
from docloom.plans.columns import NotLowerable, Val
from docloom.plans.rules.interpreter import Machine
from docloom.plans.rules.lower import Lowerer
from docloom.plans.rules.parser import Node, parse_program, parse_text

#: What a program's own variables are called in its result.
RETURN = "return"
#: The rule functions, which programs need where they run.
FUNCTIONS = _functions.FUNCTIONS


class Rule:
    """A compiled program: text, or JSON statements."""

    def __init__(self, program: Any, flags: Flags = Flags()) -> None:
        self.source, self.flags = program, flags
        self.node: Node = parse_text(program) if isinstance(program, str) else parse_program(plain(program))

    def run(self, **variables: Any) -> Machine:
        """Run on plain values in this process."""
        machine = Machine({k: plain(v) for k, v in variables.items()}, self.flags)
        machine.vars["="] = machine.run(self.node)
        return machine

    def value(self, **variables: Any) -> Any:
        return self.run(**variables).vars["="]

    def lower(self, df: DataFrame, names: dict[str, str | Column] | None = None) -> tuple[Val, Lowerer]:
        """The value and the machine after the program, with the frame's columns as variables."""
        env = {}
        for f in df.schema.fields:
            env[f.name] = Val(F.col(f"`{f.name}`"), f.dataType)
        for name, source in (names or {}).items():
            made = df.select(F.col(f"`{source}`") if isinstance(source, str) else source)
            env[name] = Val(F.col(f"`{source}`") if isinstance(source, str) else source, made.schema.fields[0].dataType)
        machine = Lowerer(env, self.flags)
        return machine.value(self.node), machine

    def column(self, df: DataFrame, names: dict[str, str | Column] | None = None) -> Column:
        """The program's value as a Column; NotLowerable where it has none."""
        return self.lower(df, names)[0].col

    def apply(self, df: DataFrame, into: str = "value", outputs: dict[str, str] | None = None, interpret: bool = False) -> DataFrame:
        """Adds the program's value, and variables (`outputs`: variable -> column, "return": the returned value).

        Columns where the program can be lowered; otherwise VARIANT columns by the interpreter.
        """
        outputs = outputs or {}
        if not interpret:
            try:
                value, machine = self.lower(df)
                made = {into: value.col}
                for name, column in outputs.items():
                    if name == RETURN:
                        found = machine.returned[-1] if machine.returned else Val(F.lit(None).cast("variant"), None)
                    else:
                        found = machine.env.get(name) or Val(F.lit(None).cast("variant"), None)
                    made[column] = F.when(machine.done, found.col) if name == RETURN and machine.done is not None else found.col
                return df.withColumns(made)
            except NotLowerable:
                pass
        return self._interpret(df, into, outputs)

    def _interpret(self, df: DataFrame, into: str, outputs: dict[str, str]) -> DataFrame:
        source, flags = self.source, self.flags
        columns = [into, *outputs.values()]
        kept = [c for c in df.columns if c not in columns]
        variants = {c for c in kept if isinstance(df.schema[c].dataType, T.VariantType)}
        document = F.to_json(F.to_variant_object(F.struct(*[Val(F.col(f"`{c}`"), df.schema[c].dataType).variant().alias(c) for c in df.columns])))
        frame = df.select(*[F.to_json(f"`{c}`").alias(c) if c in variants else F.col(f"`{c}`") for c in kept], document.alias("__row"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rule = Rule(source, flags)
            for batch in batches:
                out: list[list] = [[] for _ in columns]
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    machine = rule.run(**json.loads(text, parse_int=float))
                    found = [machine.vars["="], *((machine.returned[-1] if machine.returned else None) if n == RETURN else machine.vars.get(n) for n in outputs)]
                    for column, value in zip(out, found, strict=True):
                        column.append(None if value is None else dump_json(value))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in out)], names=[*batch.schema.names[:-1], *columns])

        schema = T.StructType([*frame.schema.fields[:-1], *(T.StructField(c, T.StringType()) for c in columns)])
        done = frame.mapInArrow(run, schema)
        parsed = {c: F.try_parse_json(f"`{c}`") for c in (*columns, *variants)}
        return done.select(*[parsed[c].alias(c) if c in parsed else F.col(f"`{c}`") for c in done.columns])


def expression(df: DataFrame, text: str, **names: str | Column) -> Column:
    """An expression as a Column over a frame."""
    return Rule(text).column(df, names)
