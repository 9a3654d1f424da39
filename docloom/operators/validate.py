"""Validation and transformation of documents, one a row.

`Validator.apply` takes a DataFrame and a column (JSON text, VARIANT or struct) and adds
`doc` (the transformed document, VARIANT), `errors` (array of path and info) and `valid`.
It lowers the schema to Columns; a schema with a step that has no Column form runs in the
interpreter, in Arrow batches. Both give the same results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.values import Flags, dump_json, parse_json, plain
from docloom.plans.columns import NotLowerable, Val
from docloom.plans.schema import ERROR, Context, Lowering, Schema, compile_schema

#: How deep a recursive reference is unrolled before the interpreter takes over.
UNROLL = 4
BAD_JSON = "invalid JSON"


class ValidationError(ValueError):
    """A document with errors; the text is that of `error_text`."""


def error_text(errors: list[tuple[str, str]]) -> str:
    return "".join(f"'{p}' {i}; " for p, i in errors)


def error_text_column(errors: Column) -> Column:
    """All errors of a document as one text."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.lit("'"), e["path"], F.lit("' "), e["info"], F.lit("; "))), "")


def fenced(value: Column) -> Column:
    """The value, behind a fence that predicates are not pushed through: else they are expanded to all that they are made of,
    once for each part, and the document is parsed as often. Filters on other columns belong before a validation."""
    return F.when(F.spark_partition_id() >= 0, value)


class Validator:
    def __init__(self, spec: Any, flags: Flags = Flags(), ignored: set[str] | None = None) -> None:
        self.spec = parse_json(spec) if isinstance(spec, (str, bytes)) else spec
        self.flags, self.ignored = flags, ignored
        self.schema: Schema = compile_schema(self.spec, flags, ignored)

    # one document in this process
    def check(self, document: Any) -> tuple[Any, list[tuple[str, str]]]:
        """The transformed document (a copy) and its errors, of a text or a value."""
        if isinstance(document, (str, bytes)):
            try:
                document = parse_json(document)
            except ValueError:
                return None, [("$", BAD_JSON)]
        document = plain(document)
        context = Context(self.flags, self.schema)
        self.schema.run(context, document)
        return document, context.errors

    def validate(self, document: Any) -> Any:
        """The transformed document, or ValidationError."""
        out, errors = self.check(document)
        if errors:
            raise ValidationError(error_text(errors))
        return out

    def dump(self, indent: int | None = None) -> str:
        return json.dumps(self.spec, indent=indent, ensure_ascii=False)

    # DataFrames
    def lower(self, df: DataFrame, column: str) -> tuple[DataFrame, Val, Column, Column]:
        """The frame with intermediate columns, the document, its errors and whether it has none."""
        frame, made = df, []

        def bind(values: list[Column]) -> list[Column]:
            nonlocal frame
            names = [f"__docloom_{len(made) + k}" for k in range(len(values))]
            made.extend(names)
            frame = frame.withColumns(dict(zip(names, values, strict=True)))
            return [F.col(n) for n in names]

        dtype = df.schema[column].dataType
        source = F.col(f"`{column}`")
        broken = None
        if isinstance(dtype, T.StringType):
            parsed = bind([F.try_parse_json(source)])[0]
            broken = source.isNotNull() & parsed.isNull()
            value = Val(parsed, T.VariantType())
        else:
            value = Val(source, dtype)
        low = Lowering(bind, self.flags, self.schema, UNROLL)
        value = low.once([value])[0]
        out, errors = self.schema.lower(low, value)
        found, ok = errors.array(), errors.ok()
        if broken is not None:
            bad = F.array(F.struct(F.lit("$").alias("path"), F.lit(BAD_JSON).alias("info")))
            found, ok = F.when(broken, bad).otherwise(found), ~broken & ok
        return frame, out, found, ok

    @property
    def lowerable(self) -> bool:
        """Whether documents given as JSON text run as Columns throughout."""
        from pyspark.sql import SparkSession

        try:
            self.lower(SparkSession.active().createDataFrame([], "doc string"), "doc")
        except NotLowerable:
            return False
        return True

    def apply(self, df: DataFrame, column: str, doc: str = "doc", errors: str = "errors", valid: str = "valid", interpret: bool = False) -> DataFrame:
        if not interpret:
            try:
                frame, out, found, ok = self.lower(df, column)
                done = frame.withColumns({"__docloom_doc": out.variant(), "__docloom_errors": fenced(found), "__docloom_valid": fenced(ok)})
                kept = [F.col(f"`{c}`") for c in df.columns if c not in (doc, errors, valid)]
                return done.select(*kept, F.col("__docloom_doc").alias(doc), F.col("__docloom_errors").alias(errors), F.col("__docloom_valid").alias(valid))
            except NotLowerable:
                pass
        return self._interpret(df, column, doc, errors, valid)

    def valid(self, df: DataFrame, column: str) -> DataFrame:
        """Only the valid rows, as they are: the errors' texts are never made."""
        try:
            frame, _, _, ok = self.lower(df, column)
            return frame.withColumn("__docloom_valid", fenced(ok)).where("__docloom_valid").select(*[f"`{c}`" for c in df.columns])
        except NotLowerable:
            return self.apply(df, column, "__doc", "__errors", "__valid").where("__valid").select(*[f"`{c}`" for c in df.columns])

    def _interpret(self, df: DataFrame, column: str, doc: str, errors: str, valid: str) -> DataFrame:
        spec, flags, ignored = self.spec, self.flags, self.ignored
        kept = [c for c in df.columns if c not in (doc, errors, valid)]
        dtype = df.schema[column].dataType
        source = F.col(f"`{column}`")
        text = source if isinstance(dtype, T.StringType) else F.to_json(Val(source, dtype).variant())
        variants = [c for c in kept if isinstance(df.schema[c].dataType, T.VariantType)]
        frame = df.select(*[F.to_json(f"`{c}`").alias(c) if c in variants else F.col(f"`{c}`") for c in kept], text.alias("__text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Validator(spec, flags, ignored)
            for batch in batches:
                docs, found = [], []
                for raw in batch.column(batch.num_columns - 1).to_pylist():
                    out, errs = own.check(raw) if raw is not None else own.check(None)
                    docs.append(dump_json(out) if errs != [("$", BAD_JSON)] else None)
                    found.append([{"path": p, "info": i} for p, i in errs])
                kind = pa.list_(pa.struct([("path", pa.string()), ("info", pa.string())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(docs, pa.string()), pa.array(found, kind)], names=[*batch.schema.names[:-1], "__doc", "__errors"])

        schema = T.StructType([*frame.schema.fields[:-1], T.StructField("__doc", T.StringType()), T.StructField("__errors", T._parse_datatype_string(f"array<{ERROR}>"))])
        done = frame.mapInArrow(run, schema)
        back = [F.parse_json(f"`{c}`").alias(c) if c in variants else F.col(f"`{c}`") for c in kept]
        return done.select(*back, F.try_parse_json("__doc").alias(doc), F.col("__errors").alias(errors), (F.size("__errors") == 0).alias(valid))

    def decode(self, df: DataFrame, column: str, schema: T.StructType, into: str = "decoded") -> DataFrame:
        """Validate, then decode the transformed document to a typed struct; NULL where it is not valid."""
        from docloom.operators.decode import decode_column

        done = self.apply(df, column)
        return done.withColumn(into, F.when(F.col("valid"), decode_column(Val(F.col("doc"), T.VariantType()), schema)))


REGISTRY: dict[str, Validator] = {}


def register_schema(name: str | T.StructType, spec: Any = None, flags: Flags = Flags()) -> Validator:
    """Keep a validator by name, or by a StructType whose fields' metadata describe it."""
    from docloom.plans.infer import schema_of

    key = name if isinstance(name, str) else name.json()
    REGISTRY[key] = Validator(spec if spec is not None else schema_of(name), flags)
    return REGISTRY[key]


def registered(name: str | T.StructType) -> Validator:
    key = name if isinstance(name, str) else name.json()
    if key not in REGISTRY and not isinstance(name, str):
        return register_schema(name)
    return REGISTRY[key]
