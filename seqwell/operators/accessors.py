"""Accessors: paths into an element. They become column expressions, so only the named leaves are read from Parquet.

``.field`` of a struct or a variant of a union, ``[start:stop:stride]`` of an array, one after the other; a list of paths
gives a struct of them in the order asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwell.errors import StatementError
from seqwell.operators.positions import ELEM, POS


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Range:
    start: int = 0
    stop: int | None = None
    stride: int = 1


Path = tuple["Field | Range", ...]

_STEP = re.compile(r"\s*(?:\.?\s*([A-Za-z_]\w*)|\[\s*(\d*)\s*(?:(:)\s*(\d*)\s*(?::\s*(\d*)\s*)?)?\])")


def parse(text: str) -> Path:
    """``sensors.temps[5:8].value`` as a path; ``[3]`` is the array of element 3 alone."""
    path: list[Field | Range] = []
    at = 0
    while at < len(text.rstrip()):
        m = _STEP.match(text, at)
        if not m:
            raise StatementError(f"no accessor: {text[at:]!r}")
        if m[1]:
            path.append(Field(m[1]))
        else:
            start = int(m[2] or 0)
            stop = int(m[4]) if m[4] else None if m[3] else start + 1
            if not m[3] and not m[2] or m[5] == "0":
                raise StatementError(f"no range: {m[0]!r}")
            path.append(Range(start, stop, int(m[5] or 1)))
        at = m.end()
    return tuple(path)


def column(value: Column, path: Path) -> Column:
    """The part of `value` at `path`; a range maps the rest of the path over its elements."""
    for i, step in enumerate(path):
        if isinstance(step, Field):
            value = value[step.name]
            continue
        rest = path[i + 1 :]
        if step.stop is None:
            part = F.slice(value, F.lit(step.start + 1), F.greatest(F.size(value) - step.start, F.lit(0)))
        else:
            part = F.slice(value, step.start + 1, max(0, step.stop - step.start))
        if step.stride > 1:
            part = _strided(part, step.stride)
        return F.transform(part, lambda x: column(x, rest)) if rest else part
    return value


def replaced(value: Column, path: Path, new: Column, variants: tuple[Path, ...] = ()) -> Column:
    """`value` with its part at `path` overwritten by `new`, of the form that `column` gives; of a range as many elements as `new` has.

    variants: paths, without their ranges, that name a variant of a union. A variant that is written whole becomes the one that is set; a part of a variant is written only where that is set."""

    def put(value: Column, at: int, new: Column) -> Column:
        if at == len(path):
            return new
        step = path[at]
        if isinstance(step, Range):
            inside = lambda j: (j >= step.start) & (j < (step.start + F.size(new) * step.stride)) & ((j - step.start) % step.stride == 0)
            within = (lambda j: inside(j) if step.stop is None else inside(j) & (j < step.stop))
            return F.transform(value, lambda x, j: F.when(within(j), put(x, at + 1, F.get(new, ((j - step.start) / step.stride).cast("int")))).otherwise(x))
        part = put(value[step.name], at + 1, new)
        named = tuple(s for s in path[: at + 1] if isinstance(s, Field))
        if named not in variants:
            return value.withField(step.name, part)
        if at + 1 < len(path):
            return F.when(value["_tag"] == step.name, value.withField(step.name, part)).otherwise(value)
        others = [v[-1].name for v in variants if v[:-1] == named[:-1] and v != named]
        out = value.withField("_tag", F.lit(step.name)).withField(step.name, part)
        for other in others:
            out = out.withField(other, F.when(F.lit(False), value[other]))
        return out

    return put(value, 0, new)


def _strided(part: Column, stride: int) -> Column:
    return F.filter(part, lambda _, j: j % stride == 0)


def select(seq: DataFrame, *paths: str | Path) -> DataFrame:
    """`seq` with elem reduced to a path, or to a struct of several, in the order given; fields are named by their last name, numbered where that repeats."""
    parsed = [parse(p) if isinstance(p, str) else p for p in paths]
    if not parsed:
        raise StatementError("no accessor is given")
    if len(parsed) == 1:
        return seq.select(POS, column(F.col(ELEM), parsed[0]).alias(ELEM))
    names: list[str] = []
    for p in parsed:
        name = own = next((s.name for s in reversed(p) if isinstance(s, Field)), "value")
        count = 1
        while own in names:
            count += 1
            own = f"{name}_{count}"
        names.append(own)
    return seq.select(POS, F.struct(*[column(F.col(ELEM), p).alias(n) for p, n in zip(parsed, names, strict=True)]).alias(ELEM))


def byte_range(packed: Column, offset: int, size: int, *, count: int = 1, skip: int = 0) -> Column:
    """Bytes of a packed element: `count` runs of `size` bytes, `skip` bytes apart, from `offset` on."""
    runs = [F.substring(packed, offset + i * (size + skip) + 1, size) for i in range(count)]
    return runs[0] if count == 1 else F.concat(*runs)


def gather(value: Column, runs: list[tuple[int, int, int, int]]) -> Column:
    """One array from runs (start, count of reads, elements read, elements skipped) in any order of starts."""
    parts = []
    for start, reads, size, skip in runs:
        whole = F.slice(value, start + 1, max(0, reads * (size + skip) - skip))
        parts.append(whole if not skip else _runs(whole, size, skip))
    return F.concat(*parts)


def _runs(whole: Column, size: int, skip: int) -> Column:
    return F.filter(whole, lambda _, j: j % (size + skip) < size)
