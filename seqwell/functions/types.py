"""The type system: primitives, structs, unions, enums and fixed-size arrays, and how they map to Spark types.

Text form, as it is parsed and printed: ``u8``, ``struct { a u32, b [10] f32 }``, ``union { ... }``, ``enum { A, B }``,
``[2][3] i16``. Sizes are those of the packed form, without padding; multi-byte numbers are little-endian when packed.

Spark has no unsigned, half, quad or complex types: unsigned ones take the next wider type with a range check, f16 is a
FLOAT, f128 a DOUBLE and so loses precision, complex ones are STRUCT<re, im>. A union is a STRUCT of nullable variants with
the name of the one that is set in `_tag`, which is stricter than overlapping storage; an enum is a STRING of its keys.
"""

from __future__ import annotations

import random
import re
import struct
from dataclasses import dataclass

from pyspark.sql import types as T

from seqwell.errors import CorruptError, RangeError, StatementError

#: Name, bytes, family and bits of one part.
PRIMITIVES = {
    "u8": (1, "u", 8), "u16": (2, "u", 16), "u32": (4, "u", 32), "u64": (8, "u", 64),
    "i8": (1, "i", 8), "i16": (2, "i", 16), "i32": (4, "i", 32), "i64": (8, "i", 64),
    "f16": (2, "f", 16), "f32": (4, "f", 32), "f64": (8, "f", 64), "f128": (16, "f", 128),
    "cf32": (4, "cf", 16), "cf64": (8, "cf", 32), "cf128": (16, "cf", 64), "cf256": (32, "cf", 128),
    "ci16": (2, "ci", 8), "ci32": (4, "ci", 16), "ci64": (8, "ci", 32), "ci128": (16, "ci", 64),
    "cu16": (2, "cu", 8), "cu32": (4, "cu", 16), "cu64": (8, "cu", 32), "cu128": (16, "cu", 64),
}
F16_MAX, F32_MAX, F64_MAX = 65504.0, 3.4028234663852886e38, 1.7976931348623157e308


class Type:
    def __str__(self) -> str:
        raise NotImplementedError

    @property
    def size(self) -> int:
        """Bytes of the packed form."""
        raise NotImplementedError

    def spark(self) -> T.DataType:
        raise NotImplementedError

    def validate(self) -> None:
        """Raises StatementError unless the type is well formed."""

    def pack(self, value) -> bytes:
        raise NotImplementedError

    def unpack(self, raw: bytes):
        raise NotImplementedError

    def serialize(self) -> bytes:
        """The type itself, as bytes; the text form is also the stored one."""
        return str(self).encode()


@dataclass(frozen=True)
class Prim(Type):
    name: str

    def __str__(self) -> str:
        return self.name

    def validate(self) -> None:
        if self.name not in PRIMITIVES:
            raise StatementError(f"no such primitive: {self.name}")

    @property
    def size(self) -> int:
        return PRIMITIVES[self.name][0]

    @property
    def family(self) -> str:
        return PRIMITIVES[self.name][1]

    @property
    def bits(self) -> int:
        return PRIMITIVES[self.name][2]

    @property
    def is_int(self) -> bool:
        return self.family in ("u", "i")

    @property
    def is_float(self) -> bool:
        return self.family == "f"

    @property
    def is_complex(self) -> bool:
        return self.family[0] == "c"

    @property
    def numpy(self) -> str | None:
        """The numpy type of the packed form, if Spark's type holds all its values as they are."""
        return f"<{self.family}{self.size}" if self.family in ("u", "i", "f") and self.size <= 8 and self.name != "u64" else None

    def limits(self) -> tuple[float, float]:
        """Least and largest value of a number, or of each part of a complex one."""
        kind = self.family[-1]
        if kind == "u":
            return 0, (1 << self.bits) - 1
        if kind == "i":
            return -(1 << self.bits - 1), (1 << self.bits - 1) - 1
        most = {16: F16_MAX, 32: F32_MAX}.get(self.bits, F64_MAX)
        return -most, most

    def part(self) -> T.DataType:
        kind, bits = self.family[-1], self.bits
        if kind == "u":
            return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[bits]
        if kind == "i":
            return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[bits]
        return T.FloatType() if bits <= 32 else T.DoubleType()

    def spark(self) -> T.DataType:
        part = self.part()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)]) if self.is_complex else part

    def _pack(self, x) -> bytes:
        low, high = self.limits()
        if not low <= x <= high and x == x and abs(x) != float("inf"):
            raise RangeError(f"{x} is out of the range of {self}")
        kind, n = self.family[-1], self.bits // 8
        if kind in "ui":
            return int(x).to_bytes(n, "little", signed=kind == "i")
        if n == 16:  # as a double and eight bytes of zero: Spark holds no more
            return struct.pack("<d", x) + bytes(8)
        return struct.pack({2: "<e", 4: "<f", 8: "<d"}[n], x)

    def _unpack(self, raw: bytes):
        kind, n = self.family[-1], self.bits // 8
        if kind in "ui":
            return int.from_bytes(raw[:n], "little", signed=kind == "i")
        return struct.unpack({2: "<e", 4: "<f", 8: "<d", 16: "<d"}[n], raw[: min(n, 8)])[0]

    def pack(self, value) -> bytes:
        if not self.is_complex:
            return self._pack(value)
        re_, im = (value.real, value.imag) if isinstance(value, complex) else (value["re"], value["im"])
        return self._pack(re_) + self._pack(im)

    def unpack(self, raw: bytes):
        if not self.is_complex:
            return self._unpack(raw)
        half = self.size // 2
        return {"re": self._unpack(raw[:half]), "im": self._unpack(raw[half:])}


def _names(kind: str, names: list[str]) -> None:
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise StatementError(f"a {kind} has one name at least, none empty and none twice: {names}")


@dataclass(frozen=True)
class Struct(Type):
    fields: tuple[tuple[str, Type], ...]

    def __str__(self) -> str:
        return "struct { " + ", ".join(f"{n} {t}" for n, t in self.fields) + " }"

    def validate(self) -> None:
        _names("struct", [n for n, _ in self.fields])
        for _, t in self.fields:
            t.validate()

    @property
    def size(self) -> int:
        return sum(t.size for _, t in self.fields)

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, t.spark()) for n, t in self.fields])

    def offset(self, name: str) -> int:
        """Where a field begins in the packed form."""
        at = 0
        for n, t in self.fields:
            if n == name:
                return at
            at += t.size
        raise StatementError(f"no field {name} in {self}")

    def pack(self, value) -> bytes:
        return b"".join(t.pack(value[n]) for n, t in self.fields)

    def unpack(self, raw: bytes):
        out, at = {}, 0
        for n, t in self.fields:
            out[n] = t.unpack(raw[at : at + t.size])
            at += t.size
        return out


@dataclass(frozen=True)
class Union(Type):
    variants: tuple[tuple[str, Type], ...]

    def __str__(self) -> str:
        return "union { " + ", ".join(f"{n} {t}" for n, t in self.variants) + " }"

    def validate(self) -> None:
        _names("union", [n for n, _ in self.variants])
        for _, t in self.variants:
            t.validate()

    @property
    def size(self) -> int:
        return max(t.size for _, t in self.variants)

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField("_tag", T.StringType()), *(T.StructField(n, t.spark()) for n, t in self.variants)])

    def pack(self, value) -> bytes:
        tag = value.get("_tag") or next(k for k in value)
        return dict(self.variants)[tag].pack(value[tag]).ljust(self.size, b"\0")

    def unpack(self, raw: bytes):
        """Every variant read from the same bytes, as nothing says which was set."""
        return {n: t.unpack(raw[: t.size]) for n, t in self.variants}


@dataclass(frozen=True)
class Enum(Type):
    keys: tuple[str, ...]

    def __str__(self) -> str:
        return "enum { " + ", ".join(self.keys) + " }"

    def validate(self) -> None:
        _names("enum", list(self.keys))
        if len(self.keys) > 256:
            raise StatementError("an enum has 256 keys at most, as it is stored in a byte")

    @property
    def size(self) -> int:
        return 1

    def spark(self) -> T.DataType:
        return T.StringType()

    def pack(self, value) -> bytes:
        return bytes([self.keys.index(value)])

    def unpack(self, raw: bytes):
        if raw[0] >= len(self.keys):
            raise CorruptError(f"{raw[0]} is no key of {self}")
        return self.keys[raw[0]]


@dataclass(frozen=True)
class SArray(Type):
    dims: tuple[int, ...]
    elem: Type

    def __str__(self) -> str:
        return "".join(f"[{d}]" for d in self.dims) + f" {self.elem}"

    def validate(self) -> None:
        if not self.dims or any(d < 1 for d in self.dims):
            raise StatementError(f"an array has one dimension at least, each of 1 or more: {self.dims}")
        if isinstance(self.elem, SArray):
            raise StatementError("an array of arrays is one array of more dimensions")
        self.elem.validate()

    @property
    def size(self) -> int:
        n = self.elem.size
        for d in self.dims:
            n *= d
        return n

    def inner(self) -> Type:
        return SArray(self.dims[1:], self.elem) if len(self.dims) > 1 else self.elem

    def spark(self) -> T.DataType:
        return T.ArrayType(self.inner().spark())

    def pack(self, value) -> bytes:
        if len(value) != self.dims[0]:
            raise StatementError(f"{len(value)} elements for {self}")
        return b"".join(self.inner().pack(x) for x in value)

    def unpack(self, raw: bytes):
        t = self.inner()
        return [t.unpack(raw[i * t.size : (i + 1) * t.size]) for i in range(self.dims[0])]


_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|\d+|[{}\[\],])")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        return m[1] if m else ""

    def take(self, want: str | None = None) -> str:
        m = _TOKEN.match(self.text, self.at)
        if not m or want not in (None, m[1]):
            raise StatementError(f"expected {want or 'a type'} at {self.text[self.at :]!r}")
        self.at = m.end()
        return m[1]

    def members(self, typed: bool) -> tuple:
        out = []
        self.take("{")
        while self.peek() != "}":
            name = self.take()
            if not re.match(r"[A-Za-z_]", name):
                raise StatementError(f"no name: {name}")
            out.append((name, self.type()) if typed else name)
            if self.peek() != "}":
                self.take(",")
        self.take("}")
        return tuple(out)

    def type(self) -> Type:
        word = self.peek()
        if word == "[":
            dims = []
            while self.peek() == "[":
                self.take("[")
                size = self.take()
                if not size.isdigit():
                    raise StatementError(f"no dimension: {size}")
                dims.append(int(size))
                self.take("]")
            return SArray(tuple(dims), self.type())
        self.take()
        if word in ("struct", "union"):
            return (Struct if word == "struct" else Union)(self.members(True))
        if word == "enum":
            return Enum(self.members(False))
        return Prim(word.lower())


def parse(text: str) -> Type:
    """The type that `text` spells; commas may trail."""
    reader = _Reader(text)
    out = reader.type()
    if text[reader.at :].strip():
        raise StatementError(f"text after the type: {text[reader.at :]!r}")
    out.validate()
    return out


def deserialize(raw: bytes) -> Type:
    return parse(raw.decode())


def equal(a: Type, b: Type) -> bool:
    """Same form with the same members in the same order."""
    return a == b


def random_type(rng: random.Random, depth: int = 3) -> Type:
    kind = rng.randrange(8) if depth else 0
    name = lambda i: f"{rng.choice('abcdefgh')}{i}"
    if kind < 4:
        return Prim(rng.choice(list(PRIMITIVES)))
    if kind in (4, 5):
        return (Struct if kind == 4 else Union)(tuple((name(i), random_type(rng, depth - 1)) for i in range(rng.randint(1, 4))))
    if kind == 6:
        return Enum(tuple(name(i) for i in range(rng.randint(1, 5))))
    dims, elem = tuple(rng.randint(1, 4) for _ in range(rng.randint(1, 3))), random_type(rng, depth - 1)
    return SArray(dims + elem.dims, elem.elem) if isinstance(elem, SArray) else SArray(dims, elem)
