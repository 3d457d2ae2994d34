"""Declared column types and what they are in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tesserae.errors import EngineError

#: declared name -> (aliases, Spark type, value that ALTER TABLE ADD COLUMN fills old rows with)
_SIMPLE = {
    "Int8": ("tinyint", T.ByteType(), 0), "Int16": ("smallint", T.ShortType(), 0), "Int32": ("int integer", T.IntegerType(), 0), "Int64": ("bigint long", T.LongType(), 0),
    "UInt8": ("", T.ShortType(), 0), "UInt16": ("", T.IntegerType(), 0), "UInt32": ("", T.LongType(), 0), "UInt64": ("", T.DecimalType(20, 0), 0),
    "Float32": ("float real", T.FloatType(), 0.0), "Float64": ("double", T.DoubleType(), 0.0), "Bool": ("boolean", T.BooleanType(), False),
    "Utf8": ("string text varchar", T.StringType(), ""), "Date32": ("date", T.DateType(), "epoch"),
    "TimestampMs": ("datetime datetime64 timestamp timestamp_ms datetime64(3)", T.TimestampNTZType(), "epoch"),
    "TimestampUs": ("timestamp_us datetime64(6)", T.TimestampNTZType(), None), "TimestampNs": ("timestamp_ns datetime64(9)", T.LongType(), None), "UUID": ("", T.StringType(), None),
}
_BY_ALIAS = {a: n for n, (aliases, _, _) in _SIMPLE.items() for a in (n.lower(), *aliases.split())}
RANGES = {"UInt8": 2**8 - 1, "UInt16": 2**16 - 1, "UInt32": 2**32 - 1, "UInt64": 2**64 - 1}


@dataclass(frozen=True)
class TypeSpec:
    """A declared type: a simple one, Decimal(p,s), Array(T) or Map(K,V)."""

    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})" if self.args else self.name

    @staticmethod
    def parse(text: str) -> TypeSpec:
        text = re.sub(r"\s+", "", text)
        if (low := text.lower()) in _BY_ALIAS:
            return TypeSpec(_BY_ALIAS[low])
        if m := re.fullmatch(r"(?i)array\((.+)\)", text):
            return TypeSpec("Array", (TypeSpec.parse(m[1]),))
        if m := re.fullmatch(r"(?i)map\(([^,]+),(.+)\)", text):
            return TypeSpec("Map", (TypeSpec.parse(m[1]), TypeSpec.parse(m[2])))
        if m := re.fullmatch(r"(?i)decimal\((\d+),(\d+)\)", text):
            p, s = int(m[1]), int(m[2])
            if 1 <= p <= 38 and 0 <= s <= p:
                return TypeSpec("Decimal", (p, s))
        raise EngineError(f"unsupported type '{text}'")

    @property
    def spark(self) -> T.DataType:
        if self.name == "Array":
            return T.ArrayType(self.args[0].spark, True)
        if self.name == "Map":
            return T.MapType(self.args[0].spark, self.args[1].spark, True)
        if self.name == "Decimal":
            return T.DecimalType(*self.args)
        return _SIMPLE[self.name][1]

    @property
    def default(self):
        """What old rows get from ADD COLUMN; some types have none."""
        value = _SIMPLE[self.name][2] if self.name in _SIMPLE else None
        if value is None:
            raise EngineError(f"no default value for type {self}")
        return value

    @staticmethod
    def infer(kind: T.DataType) -> TypeSpec:
        """The declared type of a query's column, for CREATE TABLE AS."""
        match kind:
            case T.NullType():
                return TypeSpec("Utf8")
            case T.DecimalType():
                return TypeSpec("Decimal", (kind.precision, kind.scale))
            case T.ArrayType():
                return TypeSpec("Array", (TypeSpec.infer(kind.elementType),))
            case T.MapType():
                return TypeSpec("Map", (TypeSpec.infer(kind.keyType), TypeSpec.infer(kind.valueType)))
            case T.TimestampNTZType() | T.TimestampType():
                return TypeSpec("TimestampUs")
            case T.StringType() | T.CharType() | T.VarcharType():
                return TypeSpec("Utf8")
        for name in ("Int8", "Int16", "Int32", "Int64", "Float32", "Float64", "Bool", "Date32"):
            if _SIMPLE[name][1] == kind:
                return TypeSpec(name)
        raise EngineError(f"a table can't have a column of type {kind.simpleString()}")
