"""The fold over JSON lines: init once, a step for each document, a final expression.

A step whose writes are all associative (`acc = acc + f($)`, `acc += f($)`, `n++`, and keyed
`m[k($)] = m[k($)] + f($)`) becomes one distributed aggregation with partial sums before the
shuffle. Any other step depends on order; it runs once, in row order, in one task, as its
definition demands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import rules as _functions
from docloom.functions.values import dump_json, parse_json
from docloom.plans.columns import NotLowerable, Val
from docloom.plans.rules import parser as p
from docloom.plans.rules.interpreter import Machine
from docloom.plans.rules.lower import Lowerer, assigned


#: The rule functions, which a step needs where it runs.
FUNCTIONS = _functions.FUNCTIONS


@dataclass
class Sum:
    """name += value over all rows; keyed: name[key] += value."""

    name: str
    value: p.Node
    key: p.Node | None = None


def names_in(node: Any) -> set[str]:
    found = {node.name} if isinstance(node, p.Name) else set()
    for value in vars(node).values() if isinstance(node, p.Node) else ():
        for item in value if isinstance(value, tuple) else (value,):
            for part in item if isinstance(item, tuple) else (item,):
                if isinstance(part, p.Node):
                    found |= names_in(part)
    return found


def associative(step: p.Node) -> list[Sum] | None:
    """The sums that a step is made of, if it is made of nothing else."""
    items = step.items if isinstance(step, p.Seq) else (step,)
    written = assigned(step)
    sums = []
    for n in items:
        found = None
        if isinstance(n, p.Bump):
            found = _sum(n.target, p.Lit(n.by))
        elif isinstance(n, p.AddAssign):
            found = _sum(n.target, n.value)
        elif isinstance(n, p.Assign) and isinstance(n.value, p.Bin) and n.value.op == "+":
            left = n.value.left
            if isinstance(left, p.Bin) and left.op == "or" and left.right == p.Lit(0.0):
                left = left.left
            if left == n.target:
                found = _sum(n.target, n.value.right)
        if found is None or (names_in(found.value) | (names_in(found.key) if found.key else set())) & written:
            return None
        sums.append(found)
    return sums


def _sum(target: p.Node, value: p.Node) -> Sum | None:
    if isinstance(target, p.Name):
        return Sum(target.name, value)
    if isinstance(target, p.At) and isinstance(target.of, p.Name):
        return Sum(target.of.name, value, target.index)
    return None


def fold(df: DataFrame, column: str, step: str, init: str = "", final: str = "", order: str | None = None) -> Any:
    """The value of `final` (or of the last step) after folding the documents of a column.

    column: JSON text, VARIANT or struct, bound to `$`; `$idx` is the row's number by `order`.
    """
    node = p.parse_text(step)
    machine = Machine()
    machine.run(p.parse_text(init))
    if machine.error:
        raise ValueError(str(machine.error))
    sums = associative(node)
    if sums is not None and "$idx" not in names_in(node):
        try:
            machine.vars |= _aggregate(df, column, sums, machine)
            last = machine.vars[sums[-1].name]
            return machine.run(p.parse_text(final)) if final else last
        except NotLowerable:
            pass
    return _in_order(df, column, step, init, final, order)


def totals(df: DataFrame, column: str, sums: list[Sum]) -> DataFrame:
    """name, key (NULL: not keyed) and total of each sum, aggregated where the rows are."""
    dtype = df.schema[column].dataType
    source = F.col(f"`{column}`")
    value = Val(F.try_parse_json(source), T.VariantType()) if isinstance(dtype, T.StringType) else Val(source, dtype)
    rows: list[Column] = []
    for s in sums:
        low = Lowerer({"$": value})
        amount = low.value(s.value)
        if amount.kind not in ("num", "any"):
            raise NotLowerable("a sum of other than numbers")
        key = F.lit(None).cast("string") if s.key is None else low.value(s.key).string_of()
        rows.append(F.struct(F.lit(s.name).alias("name"), key.alias("key"), amount.rule_number_of().alias("amount")))
    exploded = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return exploded.groupBy("name", "key").agg(F.sum("amount").alias("total"))


def _aggregate(df: DataFrame, column: str, sums: list[Sum], machine: Machine) -> dict[str, Any]:
    out = {s.name: machine.vars.get(s.name) for s in sums}
    if any(isinstance(v, str) for v in out.values()):
        raise NotLowerable("text depends on order")
    for name, key, total in totals(df, column, sums).collect():  # a value for each variable and key: the fold's own result
        if key is None:
            out[name] = (out[name] or 0.0) + total
        else:
            out[name] = out[name] if isinstance(out[name], dict) else {}
            out[name][key] = (out[name].get(key) or 0.0) + total
    return out


def _in_order(df: DataFrame, column: str, step: str, init: str, final: str, order: str | None) -> Any:
    dtype = df.schema[column].dataType
    source = F.col(f"`{column}`")
    text = source if isinstance(dtype, T.StringType) else F.to_json(Val(source, dtype).variant())
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = df.select(place.alias("place"), text.alias("text")).repartition(1).sortWithinPartitions("place").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, node, last, idx = Machine(), p.parse_text(step), None, 0
        machine.run(p.parse_text(init))
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if line is None or not line.strip():
                    continue
                machine.vars["$"], machine.vars["$idx"] = parse_json(line), float(idx)
                value = machine.run(node)
                last = value if value is not None else last
                idx += 1
                if machine.error:
                    raise ValueError(f"row {idx - 1}: {machine.error}")
        if final:
            last = machine.run(p.parse_text(final))
        yield pa.RecordBatch.from_arrays([pa.array([dump_json(last)])], names=["result"])

    found = rows.mapInArrow(run, "result string").collect()
    return parse_json(found[0][0]) if found else None
