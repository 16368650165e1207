"""Schemas: a builder, and the leaves of a type with their levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PRIMITIVES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampNTZType(), "date": T.DateType()}


def _type(kind: str | T.DataType) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    if kind not in PRIMITIVES:
        raise ValueError(f"unknown type {kind!r}; known: {', '.join(PRIMITIVES)}")
    return PRIMITIVES[kind]


class SchemaBuilder:
    """Adds fields one by one; each call returns the builder."""

    def __init__(self):
        self.schema = T.StructType()

    def column(self, name: str, kind: str | T.DataType, required: bool = True) -> SchemaBuilder:
        self.schema.add(name, _type(kind), not required)
        return self

    def group(self, name: str, fields: T.StructType, required: bool = True) -> SchemaBuilder:
        return self.column(name, fields, required)

    def struct(self, name: str, fields: T.StructType, required: bool = False) -> SchemaBuilder:
        return self.column(name, fields, required)

    def array(self, name: str, element: str | T.DataType, element_required: bool = False, required: bool = False) -> SchemaBuilder:
        return self.column(name, T.ArrayType(_type(element), not element_required), required)

    def map(self, name: str, key: str | T.DataType, value: str | T.DataType, value_required: bool = False, required: bool = False) -> SchemaBuilder:
        return self.column(name, T.MapType(_type(key), _type(value), not value_required), required)

    def build(self) -> T.StructType:
        if not self.schema.fields:
            raise ValueError("a schema needs a field")
        return self.schema


@dataclass(frozen=True)
class Leaf:
    path: str
    kind: str
    max_def: int
    max_rep: int


def leaves(schema: T.StructType) -> list[Leaf]:
    """Depth first: the dotted path of each primitive, how many optional or repeated and how many repeated nodes lead to it."""

    def walk(kind: T.DataType, nullable: bool, path: str, d: int, r: int) -> list[Leaf]:
        d += nullable
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f.nullable, f"{path}.{f.name}", d, r)]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, kind.containsNull, f"{path}.list.element", d + 1, r + 1)
        if isinstance(kind, T.MapType):
            at = f"{path}.key_value"
            return [*walk(kind.keyType, False, f"{at}.key", d + 1, r + 1), *walk(kind.valueType, kind.valueContainsNull, f"{at}.value", d + 1, r + 1)]
        return [Leaf(path, kind.simpleString(), d, r)]

    return [x for f in schema.fields for x in walk(f.dataType, f.nullable, f.name, 0, 0)]
