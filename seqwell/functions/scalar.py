"""Scalar operators as columns: the same operators as in `literals`, with built-in expressions only.

A `Value` is a column and the kind of its type: int, decimal, complex (STRUCT<re, im>), bool, string, array or object.
Operators follow Python's signs: ``a + b``, ``a % b``, ``a ^ b``, ``~a``, ``a == b``; and, or, not are ``land``, ``lor``,
``lnot``. Integers that overflow raise, as ANSI mode does; integer division truncates and by zero raises; a decimal by
zero is infinite, modulo zero too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwell.errors import InterpretError, StatementError

NUMBERS = ("int", "decimal", "complex")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType,)):
        return "decimal"
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.StructType):
        return "complex" if t.names == ["re", "im"] else "object"
    raise StatementError(f"no literal type: {t}")


class Value:
    __hash__ = None

    def __init__(self, column: Column, kind: str, names: list[str] | None = None) -> None:
        self.column, self.kind, self.names = column, kind, names or []

    def _wrong(self, op: str, other: Value | None = None) -> StatementError:
        return StatementError(f"{op} is not defined for {self.kind}" + (f" and {other.kind}" if other is not None else ""))

    def _numbers(self, op: str, other: Value, kinds: tuple = NUMBERS) -> str:
        if self.kind not in kinds or other.kind not in kinds:
            raise self._wrong(op, other)
        return max(self.kind, other.kind, key=NUMBERS.index)

    def as_kind(self, kind: str) -> Column:
        """Promoted from int to decimal to complex."""
        if kind == self.kind:
            return self.column
        if kind == "decimal":
            return self.column.cast("double")
        return F.struct(self.column.cast("double").alias("re"), F.lit(0.0).alias("im"))

    def _both(self, op: str, other: Value) -> tuple[str, Column, Column]:
        kind = self._numbers(op, other)
        return kind, self.as_kind(kind), other.as_kind(kind)

    def __add__(self, other: Value) -> Value:
        if self.kind == other.kind and self.kind in ("string", "array"):
            return Value(F.concat(self.column, other.column), self.kind)
        if self.kind == other.kind == "object":
            if set(self.names) & set(other.names):
                raise InterpretError(f"both objects have {sorted(set(self.names) & set(other.names))}")
            return Value(F.struct(*[v.column[n].alias(n) for v in (self, other) for n in v.names]), "object", self.names + other.names)
        kind, a, b = self._both("+", other)
        return Value(a + b if kind != "complex" else _complex(a["re"] + b["re"], a["im"] + b["im"]), kind)

    def __sub__(self, other: Value) -> Value:
        kind, a, b = self._both("-", other)
        return Value(a - b if kind != "complex" else _complex(a["re"] - b["re"], a["im"] - b["im"]), kind)

    def __mul__(self, other: Value) -> Value:
        kind, a, b = self._both("*", other)
        return Value(a * b if kind != "complex" else _complex(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"]), kind)

    def __truediv__(self, other: Value) -> Value:
        kind, a, b = self._both("/", other)
        if kind == "int":
            return Value(F.call_function("div", a, b), kind)
        if kind == "decimal":
            by_zero = F.when((a == 0) | F.isnan(a.cast("double")), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
            return Value(F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), kind)
        n = b["re"] * b["re"] + b["im"] * b["im"]
        return Value(_complex((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n), kind)

    def __mod__(self, other: Value) -> Value:
        kind = self._numbers("%", other, NUMBERS[:2])
        a, b = self.as_kind(kind), other.as_kind(kind)
        if kind == "int":
            return Value(((a % b) + b) % b, kind)
        safe = F.when(b != 0, b)
        return Value(F.coalesce(F.when(b == 0, float("inf")), ((a % safe) + safe) % safe), kind)

    def __eq__(self, other: Value) -> Value:
        if self.kind in NUMBERS and other.kind in NUMBERS:
            kind, a, b = self._both("==", other)
            return Value(a == b if kind != "complex" else (a["re"] == b["re"]) & (a["im"] == b["im"]), "bool")
        if self.kind != other.kind:
            raise self._wrong("==", other)
        if self.kind == "object" and self.names != other.names:  # the order of keys counts
            return Value(F.lit(False), "bool")
        return Value(self.column == other.column, "bool")

    def __ne__(self, other: Value) -> Value:
        return Value(~(self == other).column, "bool")

    def _ranked(self, op: str, other: Value) -> tuple[Column, Column]:
        if self.kind == other.kind == "string":
            return self.column, other.column
        self._numbers(op, other)
        # a complex number counts by its squared magnitude, a scalar beside it as it is
        return self._magnitude(), other._magnitude()

    def _magnitude(self) -> Column:
        c = self.column
        return c["re"] * c["re"] + c["im"] * c["im"] if self.kind == "complex" else c

    def __gt__(self, other: Value) -> Value:
        a, b = self._ranked(">", other)
        return Value(a > b, "bool")

    def __ge__(self, other: Value) -> Value:
        a, b = self._ranked(">=", other)
        return Value(a >= b, "bool")

    def __lt__(self, other: Value) -> Value:
        a, b = self._ranked("<", other)
        return Value(a < b, "bool")

    def __le__(self, other: Value) -> Value:
        a, b = self._ranked("<=", other)
        return Value(a <= b, "bool")

    def _bits(self, op: str, other: Value, join) -> Value:
        if {self.kind, other.kind} - {"bool", "int"}:
            raise self._wrong(op, other)
        out = join(self._int(), other._int())
        return Value(out.cast("boolean"), "bool") if self.kind == other.kind == "bool" else Value(out, "int")

    def _int(self) -> Column:
        return self.column.cast("int") if self.kind == "bool" else self.column

    def __xor__(self, other: Value) -> Value:
        return self._bits("^", other, lambda a, b: a.bitwiseXOR(b))

    def __or__(self, other: Value) -> Value:
        return self._bits("|", other, lambda a, b: a.bitwiseOR(b))

    def __and__(self, other: Value) -> Value:
        return self._bits("&", other, lambda a, b: a.bitwiseAND(b))

    def __invert__(self) -> Value:
        if self.kind not in ("bool", "int"):
            raise self._wrong("~")
        return Value(F.bitwise_not(self._int()), "int")

    def __neg__(self) -> Value:
        if self.kind not in NUMBERS:
            raise self._wrong("-")
        return Value(-self.column if self.kind != "complex" else _complex(-self.column["re"], -self.column["im"]), self.kind)

    def truthy(self) -> Column:
        c = self.column
        if self.kind == "bool":
            return c
        if self.kind == "string":
            return F.length(c) > 0
        if self.kind == "array":
            return F.size(c) > 0
        return F.lit(bool(self.names)) if self.kind == "object" else self._magnitude() != 0

    def land(self, other: Value) -> Value:
        return Value(self.truthy() & other.truthy(), "bool")

    def lor(self, other: Value) -> Value:
        return Value(self.truthy() | other.truthy(), "bool")

    def lnot(self) -> Value:
        return Value(~self.truthy(), "bool")


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def value(df: DataFrame, column: str | Column) -> Value:
    """The column as a value of the kind that its type has in `df`."""
    t = df.select(column).schema[0].dataType
    kind = kind_of(t)
    return Value(F.col(column) if isinstance(column, str) else column, kind, t.names if kind == "object" else None)


def lit(x) -> Value:
    """A Python literal as a value."""
    if isinstance(x, complex):
        return Value(_complex(F.lit(x.real), F.lit(x.imag)), "complex")
    if isinstance(x, dict):
        return Value(F.struct(*[lit(v).column.alias(k) for k, v in x.items()]), "object", list(x))
    if isinstance(x, list):
        return Value(F.array(*[lit(v).column for v in x]), "array")
    return Value(F.lit(x), {bool: "bool", int: "int", float: "decimal", str: "string"}[type(x)])
