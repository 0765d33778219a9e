"""Stores: named variables, their piece tables in versioned manifests, transactions over them.

A store is a folder: ``data/<variable id>/<file>`` are Parquet tables (fpos, elem) that never change, ``manifests/v<N>.json``
are the versions: of each variable its type, length and the file of its pieces, ``pieces/<file>.json``, which a commit writes
only for variables that it changes. A version is published by creating its file, which fails if another writer was first;
until then nothing of a transaction can be seen, so a crash leaves at most files that no version names, which `vacuum`
removes. There is no log to replay when a store is opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqwell.errors import ConflictError, CorruptError, DuplicateCommitError, DuplicateVariableError, InvalidArgumentError, NoSuchVariableError
from seqwell.functions import literals, types
from seqwell.operators import accessors, positions
from seqwell.operators.positions import ELEM, POS
from seqwell.plans.pieces import Piece, Pieces
from seqwell.sources.files import Folder

#: A stride's elements up to this count are edited as pieces; more of them rewrite the range once.
SPLIT = 64
#: Pieces of a sequence from which on small neighbours are merged at commit.
COMPACT = 256
LONGEST_NAME = 9_999
#: Lists of pieces that a store holds, once read.
KEPT = 64
#: The file that notes a version every so many ones, so that opening a store does not list them all.
NOTED, EVERY = "noted", 16


class Store:
    """A store in `path`, made if it is not there. Use as a context manager, or `close`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, Folder(spark, path)
        self.path = self.root.path
        self.manifests = Folder(spark, f"{self.path}/manifests")
        self.manifests.make()
        self._read: dict[str, list[list]] = {}
        self.last_error: str | None = None
        if not self.versions():
            self.manifests.put_new("v000000000000.json", json.dumps({"version": 0, "note": "create", "variables": {}, "streams": {}}))

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; the handle just goes."""

    def error(self) -> str | None:
        """What went wrong last in a transaction of this handle."""
        return self.last_error

    def reset_errors(self) -> None:
        self.last_error = None

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.manifests.names() if n.startswith("v") and n.endswith(".json")]

    def latest(self) -> int:
        """The newest version: from the one last noted on, the first that has no successor; older ones are not listed."""
        try:
            version = int(self.manifests.read(NOTED))
            if not self.manifests.has(f"v{version:012d}.json"):
                raise ValueError
        except Exception:  # none noted yet, or just being written
            return max(self.versions())
        while self.manifests.has(f"v{version + 1:012d}.json"):
            version += 1
        return version

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads(self.manifests.read(f"v{version:012d}.json"))

    def pieces(self, entry: dict | None) -> list[list]:
        """The pieces of a variable's entry: inline while a transaction changes them, else in a file that never changes."""
        if entry is None or "pieces" in entry or entry["at"] is None:
            return [] if entry is None else entry.get("pieces", [])
        if entry["at"] not in self._read:
            if len(self._read) >= KEPT:
                self._read.clear()
            self._read[entry["at"]] = json.loads(self.root.read(f"pieces/{entry['at']}"))
        return self._read[entry["at"]]

    def history(self) -> list[tuple[int, str]]:
        """(version, what it did) of every version kept."""
        return [(v, self.manifest(v)["note"]) for v in self.versions()]

    def begin(self) -> Transaction:
        return Transaction(self)

    def at(self, version: int) -> Transaction:
        """A snapshot of an earlier version, to read from."""
        return Transaction(self, self.manifest(version), read_only=True)

    def _auto(self, work: Callable[[Transaction], Any]) -> Any:
        with self.begin() as tx:
            return work(tx)

    def create(self, name: str, type_: str | types.Type = "u8") -> Variable:
        self._auto(lambda tx: tx.create(name, type_))
        return Variable(self, name)

    def get(self, name: str) -> Variable:
        self.begin()._entry(name)
        return Variable(self, name)

    def delete(self, name: str) -> None:
        self._auto(lambda tx: tx.delete(name))

    def names(self) -> list[str]:
        return sorted(self.manifest()["variables"])

    def describe(self, name: str) -> DataFrame:
        """The pieces of a variable: file, start, count and the position of the first element."""
        pieces = self.begin()._pieces(name)
        rows = [(p.file, p.start, p.count, at) for at, p in pieces.slice(0, len(pieces))]
        return self.spark.createDataFrame(rows, "file string, start long, count long, pos long")

    def compact(self, name: str, least: int = 1 << 20) -> int:
        """Merges runs of neighbouring pieces of fewer than `least` elements into one file each; how many pieces are left."""
        return self._auto(lambda tx: tx.compact(name, least))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes versions but the last `keep`, and files that none of those names. Only while nothing else uses the store."""
        versions = self.versions()
        for v in versions[: -max(1, keep)]:
            self.manifests.delete(f"v{v:012d}.json")
        entries = [x for v in self.versions() for x in self.manifest(v)["variables"].values()]
        kept = {x["at"] for x in entries}
        named = {p[0] for x in {x["at"]: x for x in entries}.values() for p in self.pieces(x)}
        for f in self.root.names("pieces"):
            if f not in kept:
                self.root.delete(f"pieces/{f}")
        data = Folder(self.spark, f"{self.path}/data")
        gone = [f"{d}/{f}" for d in data.names() for f in data.names(d) if f"{d}/{f}" not in named]
        for f in gone:
            data.delete(f)
        return gone

    def validate(self, name: str) -> int:
        """Length of a variable, after a check of its pieces against their files and of its positions."""
        tx = self.begin()
        pieces = tx._pieces(name)
        sizes = {f: self.spark.read.parquet(f"{self.path}/data/{f}").count() for f in {p.file for p in pieces.pieces}}
        pieces.validate(sizes)
        if positions.validate(tx.read(name)) != len(pieces):
            raise CorruptError(f"{name} does not have {len(pieces)} elements")
        return len(pieces)


class Transaction:
    """Changes that become visible together. Leaving its `with` block commits, or rolls back on an exception."""

    def __init__(self, store: Store, base: dict | None = None, *, read_only: bool = False) -> None:
        self.store, self.read_only = store, read_only
        self.base = store.manifest() if base is None else base
        self.state = json.loads(json.dumps(self.base))
        self.notes: list[str] = []
        self.ended = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            if not self.ended:
                self.commit()
        else:
            self.store.last_error = f"{kind.__name__}: {error}"
            self.rollback()

    def savepoint(self) -> tuple[str, int]:
        return json.dumps(self.state), len(self.notes)

    def rollback(self, to: tuple[str, int] | None = None) -> None:
        """Undoes all changes, which ends the transaction, or those since a savepoint."""
        if to is None:
            self.ended = True
        else:
            self.state = json.loads(to[0])
            del self.notes[to[1] :]

    def commit(self) -> int:
        """Publishes the changes; the new version. Variables that another writer has not touched meanwhile are merged."""
        if self.ended:
            raise DuplicateCommitError("the transaction has ended")
        self.ended = True
        if not self.notes:
            return self.base["version"]
        for entry in self.state["variables"].values():
            if "pieces" in entry:
                rows = entry.pop("pieces")
                entry["length"], entry["at"] = sum(p[2] for p in rows), f"{uuid.uuid4().hex}.json" if rows else None
                if rows:
                    self.store.root.put(f"pieces/{entry['at']}", json.dumps(rows))
        base, state = self.base, self.state
        while True:
            state = state | {"version": base["version"] + 1, "note": "; ".join(self.notes)}
            if self.store.manifests.put_new(f"v{state['version']:012d}.json", json.dumps(state)):
                if state["version"] % EVERY == 0:
                    self.store.manifests.put(NOTED, str(state["version"]))
                return state["version"]
            latest = self.store.manifest()
            merged = {}
            for part in ("variables", "streams"):
                old, new, other = self.base[part], self.state[part], dict(latest[part])
                changed = [k for k in old.keys() | new.keys() if old.get(k) != new.get(k)]
                for k in changed:
                    if other.get(k) != old.get(k):
                        raise ConflictError(f"{k} was changed by version {latest['version']}")
                    other.pop(k, None)
                    if k in new:
                        other[k] = new[k]
                merged[part] = other
            base, state = latest, latest | merged

    def _entry(self, name: str) -> dict:
        try:
            return self.state["variables"][name]
        except KeyError:
            raise NoSuchVariableError(name) from None

    def _pieces(self, name: str) -> Pieces:
        return Pieces.load(self.store.pieces(self._entry(name)))

    def _set(self, name: str, pieces: Pieces, note: str) -> None:
        self._changing()
        self._entry(name)["pieces"] = pieces.dump()
        self.notes.append(note)

    def _changing(self) -> None:
        if self.ended:
            raise DuplicateCommitError("the transaction has ended")
        if self.read_only:
            raise InvalidArgumentError("an earlier version cannot be changed")

    def type(self, name: str) -> types.Type:
        return types.parse(self._entry(name)["type"])

    def create(self, name: str, type_: str | types.Type = "u8") -> str:
        """The new variable's id."""
        self._changing()
        if not 1 <= len(name.encode()) <= LONGEST_NAME:
            raise InvalidArgumentError(f"a name has 1 to {LONGEST_NAME} bytes")
        if name in self.state["variables"]:
            raise DuplicateVariableError(name)
        parsed = types.parse(type_) if isinstance(type_, str) else type_
        parsed.validate()
        made = uuid.uuid4().hex
        self.state["variables"][name] = {"id": made, "type": str(parsed), "pieces": []}
        self.notes.append(f"create {name}")
        return made

    def delete(self, name: str) -> None:
        self._changing()
        self._entry(name)
        del self.state["variables"][name]
        self.notes.append(f"delete {name}")

    def variable(self, name: str) -> Variable:
        self._entry(name)
        return Variable(self, name)

    def length(self, name: str) -> int:
        entry = self._entry(name)
        return sum(p[2] for p in entry["pieces"]) if "pieces" in entry else entry["length"]

    def size(self, name: str) -> int:
        """Bytes of the packed form."""
        return self.length(name) * self.type(name).size

    def _schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField("fpos", T.LongType()), T.StructField(ELEM, self.type(name).spark())])

    def _scan(self, name: str, start: int, stop: int) -> DataFrame:
        """Positions start to stop - 1 as they are: each file is read once, pruned by its Parquet statistics to the range of its pieces."""
        schema, spark = self._schema(name), self.store.spark
        by_file: dict[str, list[tuple[int, Piece]]] = {}
        for at, p in self._pieces(name).slice(start, stop):
            by_file.setdefault(p.file, []).append((at, p))
        out = None
        for file, pieces in by_file.items():
            pieces.sort(key=lambda x: x[1].start)
            rows = spark.read.schema(schema).parquet(f"{self.store.path}/data/{file}")
            rows = rows.where((F.col("fpos") >= pieces[0][1].start) & (F.col("fpos") < pieces[-1][1].start + pieces[-1][1].count))
            if len(pieces) == 1:
                rows = rows.select((F.col("fpos") + (pieces[0][0] - pieces[0][1].start)).alias(POS), ELEM)
            else:
                rows = rows.select((F.col("fpos") + _shift(pieces)).alias(POS), ELEM).where(F.col(POS).isNotNull())
            out = rows if out is None else out.unionAll(rows)
        return spark.createDataFrame([], T.StructType([T.StructField(POS, T.LongType()), schema[ELEM]])) if out is None else out

    def read(self, name: str, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
        length = self.length(name)
        m = positions.touched(length, offset, stride, n)
        return positions.read(self._scan(name, offset, offset + m * stride), offset, stride, m)

    def source(self, name: str, data) -> DataFrame:
        """`data` as (pos, elem): a DataFrame of these columns, bytes, a string (as UTF-8), an array or a list of values."""
        t = self.type(name)
        if isinstance(data, DataFrame):
            return data.select(F.col(POS).cast("long").alias(POS), F.col(ELEM).cast(t.spark()).alias(ELEM))
        if isinstance(data, str):
            data = data.encode()
        schema = T.StructType([T.StructField(POS, T.LongType()), T.StructField(ELEM, t.spark())])
        if hasattr(data, "tobytes") and hasattr(data, "dtype"):
            if t == types.Prim("u8"):
                data = data.tobytes()
            elif data.ndim == 1 and isinstance(t, types.Prim) and t.numpy and np.can_cast(data.dtype, t.numpy):
                return self._columns(data.astype(t.numpy), schema)
            else:
                data = data.tolist()
        if isinstance(data, (bytes, bytearray, memoryview)):
            raw = bytes(data)
            if len(raw) % t.size:
                raise InvalidArgumentError(f"{len(raw)} bytes are not whole elements of {t.size}")
            if isinstance(t, types.Prim) and t.numpy:
                return self._columns(np.frombuffer(raw, dtype=t.numpy), schema)
            data = [t.unpack(raw[i : i + t.size]) for i in range(0, len(raw), t.size)]
        else:
            data = [_stored(x, t) for x in data]
        return self.store.spark.createDataFrame([(i, _row(x, t)) for i, x in enumerate(data)], schema)

    def _columns(self, values: np.ndarray, schema: T.StructType) -> DataFrame:
        """A numpy array as columns."""
        elem = pa.array(values).cast(to_arrow_type(schema[ELEM].dataType))
        return self.store.spark.createDataFrame(pa.table([pa.array(np.arange(len(values), dtype=np.int64)), elem], names=[POS, ELEM]), schema)

    def _put(self, name: str, source: DataFrame, *, joined: bool = False) -> Piece:
        """Writes a new file of the elements of `source`, checked against the variable's type and for dense positions. joined: a join has left them in no order."""
        t = self.type(name)
        file = f"{self._entry(name)['id']}/{uuid.uuid4().hex}"
        path = f"{self.store.path}/data/{file}"
        bad = F.raise_error(F.concat(F.lit(f"out of the range of {t}: "), F.coalesce(F.to_json(F.struct(ELEM)), F.lit("null"))))
        rows = source.select(F.col(POS).alias("fpos"), F.when(literals.fits(F.col(ELEM), t), F.col(ELEM)).otherwise(bad.cast(t.spark())).alias(ELEM))
        (rows.repartitionByRange("fpos") if joined else rows).sortWithinPartitions("fpos").write.parquet(path)
        n, apart = self._checked(name, path)
        if not apart:
            # ranges of the files overlap, so reads could not leave files out: write them once more, dealt by ranges
            old, file = path, f"{self._entry(name)['id']}/{uuid.uuid4().hex}"
            path = f"{self.store.path}/data/{file}"
            self.store.spark.read.schema(self._schema(name)).parquet(old).repartitionByRange("fpos").sortWithinPartitions("fpos").write.parquet(path)
            self.store.root.delete(f"data/{old.rsplit('/data/', 1)[1]}")
            n, _ = self._checked(name, path)
        return Piece(file, 0, n)

    def _checked(self, name: str, path: str) -> tuple[int, bool]:
        """How many elements a new table has, after a check of its positions, and whether the ranges of its files are apart: from one row a file."""
        rows = self.store.spark.read.schema(self._schema(name)).parquet(path).select("fpos", F.col("_metadata.file_name").alias("file"))
        files = sorted(tuple(r) for r in positions.kinds(rows, "fpos", "file").select("low", "high", "n", "kinds").collect())
        n, different = sum(f[2] for f in files), sum(f[3] for f in files)
        apart = all(a[1] < b[0] for a, b in zip(files, files[1:], strict=False))
        if apart and n and (files[0][0], files[-1][1], different) != (0, n - 1, n) or not apart and positions.kinds(rows, "fpos").first()[:] != (n, 0, n - 1, n):
            self.store.root.delete(f"data/{path.rsplit('/data/', 1)[1]}")
            raise InvalidArgumentError(f"the positions of the source are not 0 to {n - 1}, each once")
        return n, apart

    def insert(self, name: str, data, offset: int | None = None) -> int:
        """Inserts before `offset`, at the end if that is None or beyond it; how many elements."""
        self._changing()
        if offset is not None and offset < 0:
            raise InvalidArgumentError(f"offset {offset} is negative")
        pieces = self._pieces(name)
        new = self._put(name, self.source(name, data))
        if new.count:
            at = len(pieces) if offset is None else min(offset, len(pieces))
            self._set(name, pieces.insert(at, [new]), f"insert {name} {at} {new.count}")
            self._compact_if_many(name)
        return new.count

    def append(self, name: str, data) -> int:
        return self.insert(name, data)

    def write(self, name: str, data, offset: int = 0, stride: int = 1, n: int | None = None) -> int:
        """Overwrites elements offset, offset + stride, ... in place, never beyond the end; how many."""
        self._changing()
        pieces = self._pieces(name)
        m = positions.touched(len(pieces), offset, stride, n)
        if not m:
            return 0
        new = self._put(name, self.source(name, data))
        m = min(m, new.count)
        if stride == 1:
            pieces = pieces.replace(offset, [new.part(0, m)])
        elif m <= SPLIT:
            for i in range(m):
                pieces = pieces.replace(offset + i * stride, [new.part(i, 1)])
        else:
            end = offset + (m - 1) * stride + 1
            old = self._scan(name, offset, end).select((F.col(POS) - offset).alias(POS), ELEM)
            source = self.store.spark.read.schema(self._schema(name)).parquet(f"{self.store.path}/data/{new.file}").withColumnRenamed("fpos", POS)
            pieces = pieces.replace(offset, [self._put(name, positions.write(old, source, 0, stride, m), joined=True)])
        if m:
            self._set(name, pieces, f"write {name} {offset} {stride} {m}")
            self._compact_if_many(name)
        return m

    def remove(self, name: str, offset: int = 0, stride: int = 1, n: int | None = None) -> int:
        """Removes elements offset, offset + stride, ... and closes the gaps; how many."""
        self._changing()
        pieces = self._pieces(name)
        m = positions.touched(len(pieces), offset, stride, n)
        if not m:
            return 0
        end = offset + (m - 1) * stride + 1
        if stride == 1:
            pieces = pieces.cut(offset, end)
        elif m <= SPLIT:
            for i in reversed(range(m)):
                pieces = pieces.cut(offset + i * stride, offset + i * stride + 1)
        else:
            left = positions.remove(self._scan(name, offset, end).select((F.col(POS) - offset).alias(POS), ELEM), 0, stride, m, size=end - offset)
            pieces = pieces.cut(offset, end).insert(offset, [self._put(name, left)])
        self._set(name, pieces, f"remove {name} {offset} {stride} {m}")
        self._compact_if_many(name)
        return m

    def take(self, name: str, offset: int = 0, stride: int = 1, n: int | None = None) -> DataFrame:
        """Removes elements and returns them; they are read from files that the removal leaves alone."""
        taken = self.read(name, offset, stride, n)
        self.remove(name, offset, stride, n)
        return taken

    def compact(self, name: str, least: int) -> int:
        self._changing()
        pieces = self._pieces(name)
        for start, stop in reversed(pieces.small_runs(least)):
            merged = self._put(name, self._scan(name, start, stop).select((F.col(POS) - start).alias(POS), ELEM))
            pieces = pieces.cut(start, stop).insert(start, [merged])
            self._set(name, pieces, f"compact {name} {start} {stop}")
        return len(pieces.pieces)

    def _compact_if_many(self, name: str) -> None:
        pieces = self._pieces(name)
        if len(pieces.pieces) >= COMPACT:
            self.compact(name, max(2, 4 * len(pieces) // COMPACT))


def _shift(pieces: list[tuple[int, Piece]]) -> Column:
    """How far a row of a file moves, null if no piece has it: a balanced tree of comparisons over pieces in order of their start."""
    if len(pieces) == 1:
        at, p = pieces[0]
        return F.when((F.col("fpos") >= p.start) & (F.col("fpos") < p.start + p.count), F.lit(at - p.start).cast("long"))
    half = len(pieces) // 2
    return F.when(F.col("fpos") < pieces[half][1].start, _shift(pieces[:half])).otherwise(_shift(pieces[half:]))


def _stored(x, t: types.Type):
    """A literal in the stored form, after a check of its range."""
    x = x.asDict(recursive=True) if hasattr(x, "asDict") else x
    if isinstance(t, types.Union) and isinstance(x, dict):
        x = {k: v for k, v in x.items() if k != "_tag" and v is not None}
    if isinstance(t, types.Prim) and t.is_complex and isinstance(x, dict):
        x = complex(x["re"], x["im"])
    literals.check(x, t) if not isinstance(t, types.Prim) or not isinstance(x, complex) else None
    if isinstance(t, types.SArray) and isinstance(x, str):
        return list(x.encode().ljust(t.dims[0], b"\0"))
    if isinstance(t, types.SArray):
        return [_stored(v, t.inner()) for v in x]
    if isinstance(t, types.Struct):
        return {n: _stored(x[n], f) for n, f in t.fields}
    if isinstance(t, types.Union):
        (tag, v), = x.items()
        return {"_tag": tag, tag: _stored(v, dict(t.variants)[tag])}
    if isinstance(t, types.Prim) and t.is_int:
        return int(x)
    return x


def _row(x, t: types.Type):
    """A stored value as Spark's Row wants it."""
    import decimal

    if isinstance(t, types.Prim):
        if t.is_complex:
            re, im = (x["re"], x["im"]) if isinstance(x, dict) else (x.real, x.imag) if isinstance(x, complex) else (x, 0)
            one = types.Prim({"f": "f64", "i": "i64", "u": "u64" if t.bits == 64 else "i64"}[t.family[-1]])
            return tuple(_row(p if t.family == "cf" else int(p), one) for p in (re, im))
        if t.name == "u64":
            return decimal.Decimal(int(x))
        return float(x) if t.is_float else int(x)
    if isinstance(t, types.SArray):
        return [_row(v, t.inner()) for v in x]
    if isinstance(t, types.Struct):
        return tuple(_row(x[n], f) for n, f in t.fields)
    if isinstance(t, types.Union):
        return (x.get("_tag"), *(_row(x[n], f) if n == x.get("_tag") else None for n, f in t.variants))
    return x


def _variants(t: types.Type, above: accessors.Path = ()) -> tuple[accessors.Path, ...]:
    """The paths of fields, ranges left out, that name a variant of a union."""
    if isinstance(t, types.SArray):
        return _variants(t.inner(), above)
    if not isinstance(t, (types.Struct, types.Union)):
        return ()
    parts = t.variants if isinstance(t, types.Union) else t.fields
    own = tuple((*above, accessors.Field(n)) for n, _ in parts) if isinstance(t, types.Union) else ()
    return own + tuple(p for n, f in parts for p in _variants(f, (*above, accessors.Field(n))))


class Variable:
    """A sequence by its name, in a store (each change a transaction of its own) or in a transaction.

    ``len(v)`` and slices count elements: ``v[a:b:c]`` is a DataFrame (pos, elem), ``v[a:b:c] = data`` overwrites as many
    elements as `data` has, whatever `b` says, ``del v[a:b:c]`` removes, ``v.taking()[a:b:c]`` removes and returns.
    """

    def __init__(self, owner: Store | Transaction, name: str) -> None:
        self.owner, self.name = owner, name

    def _look(self) -> Transaction:
        return self.owner if isinstance(self.owner, Transaction) else self.owner.begin()

    def _change(self, work: Callable[[Transaction], Any]) -> Any:
        return work(self.owner) if isinstance(self.owner, Transaction) else self.owner._auto(work)

    @property
    def id(self) -> str:
        return self._look()._entry(self.name)["id"]

    @property
    def type(self) -> types.Type:
        return self._look().type(self.name)

    def __len__(self) -> int:
        return self._look().length(self.name)

    def size(self) -> int:
        """Bytes of the packed form."""
        return self._look().size(self.name)

    def read(self, offset: int = 0, stride: int = 1, n: int | None = None, accessor: str | list[str] | None = None) -> DataFrame:
        out = self._look().read(self.name, offset, stride, n)
        return out if accessor is None else accessors.select(out, *([accessor] if isinstance(accessor, str) else accessor))

    def insert(self, offset: int, data) -> int:
        return self._change(lambda tx: tx.insert(self.name, data, offset))

    def append(self, data) -> int:
        return self._change(lambda tx: tx.insert(self.name, data))

    def write(self, data, offset: int = 0, stride: int = 1, n: int | None = None, accessor: str | accessors.Path | None = None) -> int:
        """Overwrites elements or, with an accessor of fields and ranges, only that part of each."""
        if accessor is None:
            return self._change(lambda tx: tx.write(self.name, data, offset, stride, n))
        path = accessors.parse(accessor) if isinstance(accessor, str) else accessor

        def work(tx: Transaction) -> int:
            old = tx.read(self.name, offset, stride, n)
            kind = accessors.select(old, path).schema[ELEM].dataType
            rows = data if isinstance(data, DataFrame) else tx.store.spark.createDataFrame(list(enumerate(data)), T.StructType([T.StructField(POS, T.LongType()), T.StructField(ELEM, kind)]))
            met = old.join(rows.select(POS, F.col(ELEM).cast(kind).alias("_new")), POS)
            new = accessors.replaced(F.col(ELEM), path, F.col("_new"), _variants(tx.type(self.name)))
            return tx.write(self.name, met.select(POS, new.alias(ELEM)), offset, stride, n)

        return self._change(work)

    def remove(self, offset: int = 0, stride: int = 1, n: int | None = None) -> int:
        return self._change(lambda tx: tx.remove(self.name, offset, stride, n))

    def take(self, offset: int = 0, stride: int = 1, n: int | None = None, accessor: str | list[str] | None = None) -> DataFrame:
        out = self._change(lambda tx: tx.take(self.name, offset, stride, n))
        return out if accessor is None else accessors.select(out, *([accessor] if isinstance(accessor, str) else accessor))

    def __getitem__(self, key: slice) -> DataFrame:
        return self.read(*positions.slice_pattern(len(self), key))

    def __setitem__(self, key: slice, data) -> None:
        offset, stride, _ = positions.slice_pattern(len(self), key)
        self.write(data, offset, stride)

    def __delitem__(self, key: slice) -> None:
        self.remove(*positions.slice_pattern(len(self), key))

    def taking(self) -> _Taking:
        return _Taking(self)

    def values(self, key: slice = slice(None)) -> list:
        """Elements on the driver, in order: for small reads."""
        return [r[ELEM] for r in self[key].orderBy(POS).collect()]

    def to_bytes(self, key: slice = slice(None)) -> bytes:
        """Elements in the packed form, on the driver."""
        t = self.type
        if isinstance(t, types.Prim) and t.numpy:
            return self[key].orderBy(POS).select(ELEM).toArrow().column(0).to_numpy().astype(t.numpy).tobytes()
        return b"".join(t.pack(x.asDict(recursive=True) if hasattr(x, "asDict") else x) for x in self.values(key))


class _Taking:
    def __init__(self, variable: Variable) -> None:
        self.variable = variable

    def __getitem__(self, key: slice) -> DataFrame:
        return self.variable.take(*positions.slice_pattern(len(self.variable), key))
