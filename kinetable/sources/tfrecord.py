"""Record files of example messages: ``format("tfrecord")``, read and written.

A record is its length, a masked CRC-32C of the length, the bytes and a masked CRC-32C of these.  A message holds features by name:
bytes, floats or integers (an example), or lists of features besides (a sequence example).  The schema tells what is read:

* a number, string or binary column takes a feature's first value, an array all of them; ``array<array<...>>`` (or ``array`` with
  option ``record=SequenceExample``) takes a feature list, a step each;
* booleans and timestamps are integers (microseconds), doubles are floats of 32 bits;
* features that the schema doesn't name are skipped unread, columns that a record lacks are null.

A partition is a shard; a shard is read as a stream, a few megabytes at a time, so its size doesn't matter.  Shards that
end in .gz are gzip streams.  A record that doesn't match its checksum fails the read with the shard's name and the place, or is
left out with ``mode=dropMalformed`` (from a broken length on, the rest of the shard).  Written shards come in one piece: see ``staged``.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.crc32c import crc32c, masked, masked_one
from .staged import StagedWriter, files_of, system_of

BATCH_RECORDS = 2_048
BATCH_BYTES = 4 << 20
_BYTES, _FLOATS, _INTEGERS = 1, 2, 3


class BrokenRecord(ValueError):
    pass


def checksums(parts: list[bytes]) -> np.ndarray:
    return masked(crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])))


def framed(stream, shard: str, verify: bool = True, drop: bool = False):
    """Lists of records of a stream, checked a batch at a time."""
    place, more = 0, True
    while more:
        heads, bodies, sums, places, size = [], [], [], [], 0
        while more and len(bodies) < BATCH_RECORDS and size < BATCH_BYTES:
            head = stream.read(12)
            if not head:
                more = False
                break
            n = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else -1
            if n < 0 or (verify or n > BATCH_BYTES) and masked_one(head[:8]) != struct.unpack("<I", head[8:])[0]:
                if drop:
                    more = False
                    break
                raise BrokenRecord(f"{shard}: the length of the record at byte {place} is broken")
            body = stream.read(n + 4)
            if len(body) != n + 4:
                if drop:
                    more = False
                    break
                raise BrokenRecord(f"{shard}: the record at byte {place} is cut off")
            heads.append(head)
            bodies.append(body[:-4])
            sums.append(struct.unpack("<I", body[-4:])[0])
            places.append(place)
            place, size = place + 16 + n, size + n
        if verify and bodies:
            broken = np.flatnonzero(checksums(bodies) != np.array(sums, np.uint32)).tolist()
            if broken and not drop:
                raise BrokenRecord(f"{shard}: the record at byte {places[broken[0]]} doesn't match its checksum")
            gone = set(broken)
            bodies = [b for k, b in enumerate(bodies) if k not in gone]
        if bodies:
            yield bodies


# The wire format: a key (number of the field, kind) before each value.


def _varint(b, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[at]
        at += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, at
        shift += 7


def fields(b):
    """(number, value) of a message's fields: views of bytes, or integers."""
    at, end = 0, len(b)
    while at < end:
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 2:
            n, at = _varint(b, at)
            if at + n > end:
                raise BrokenRecord("a field is cut off")
            yield key >> 3, b[at : at + n]
            at += n
        elif kind == 0:
            value, at = _varint(b, at)
            yield key >> 3, value
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, b[at : at + n]
            at += n
        else:
            raise BrokenRecord(f"a field of kind {kind}")


def _integers(b) -> list[int]:
    """Packed integers of 64 bits, two's complement."""
    raw = np.frombuffer(b, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.add.reduceat(parts, first).view(np.int64).tolist() if len(last) else []


def feature(b) -> list:
    """The values of a feature, bytes, floats or integers."""
    out: list = []
    for kind, body in fields(b):
        for _, value in fields(body):
            if kind == _BYTES:
                out.append(bytes(value))
            elif kind == _FLOATS:
                out += np.frombuffer(value, "<f4").astype(float).tolist()
            elif isinstance(value, int):
                out.append(value - (1 << 64) if value >> 63 else value)
            else:
                out += _integers(value)
    return out


def _entries(b, wanted):
    """(name, value) of a map's entries whose names are wanted."""
    for known, entry in fields(b):
        if known != 1:
            continue
        name, value = b"", b""
        for number, x in fields(entry):
            if number == 1:
                name = bytes(x)
            else:
                value = x
        if name in wanted:
            yield name, value


def decode(record: bytes, wanted: set[bytes]) -> dict[bytes, list]:
    """The wanted features, by name; of a feature list a list for each step."""
    out: dict[bytes, list] = {}
    for number, body in fields(memoryview(record)):
        if number > 2:
            continue
        for name, value in _entries(body, wanted):
            out[name] = feature(value) if number == 1 else [feature(f) for _, f in fields(value)]
    return out


def _key(number: int, body: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(body)) + body


def _number(x: int) -> bytes:
    out = bytearray()
    x &= (1 << 64) - 1
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def encode_feature(values: list) -> bytes:
    """A feature of the kind of its values; an empty one has no kind."""
    if not values:
        return b""
    if isinstance(values[0], (bytes, str)):
        return _key(_BYTES, b"".join(_key(1, v.encode() if isinstance(v, str) else v) for v in values))
    if isinstance(values[0], float):
        return _key(_FLOATS, _key(1, np.array(values, "<f4").tobytes()))
    return _key(_INTEGERS, _key(1, b"".join(map(_number, values))))


def encode(features: dict[str, list], lists: dict[str, list[list]] | None = None) -> bytes:
    """An example, or with lists a sequence example."""
    entry = lambda name, body: _key(1, _key(1, name.encode()) + _key(2, body))
    out = _key(1, b"".join(entry(k, encode_feature(v)) for k, v in features.items()))
    if lists is not None:
        out += _key(2, b"".join(entry(k, b"".join(_key(1, encode_feature(step)) for step in v)) for k, v in lists.items()))
    return out


def frame(records: list[bytes]) -> bytes:
    heads = [struct.pack("<Q", len(r)) for r in records]
    return b"".join(h + struct.pack("<I", a) + r + struct.pack("<I", b) for h, a, r, b in zip(heads, checksums(heads), records, checksums(records), strict=True))


# The source.


class Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _depth(kind) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def _element(kind):
    return _element(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def _reading(kind):
    """What makes a column's value of a feature's values."""
    inner = _element(kind)
    if isinstance(inner, T.StringType):
        one = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    elif isinstance(inner, T.BinaryType):
        one = lambda v: v if isinstance(v, bytes) else str(v).encode()
    elif isinstance(inner, (T.DoubleType, T.FloatType)):
        one = float
    elif isinstance(inner, T.BooleanType):
        one = bool
    else:
        one = int
    each = lambda values, depth: [each(x, depth - 1) if isinstance(x, list) else one(x) for x in values]
    if _depth(kind):
        return lambda values: each(values, _depth(kind))
    return lambda values: one(values[0]) if values and not isinstance(values[0], list) else one(values[0][0]) if values and values[0] else None


class TfRecordReader(DataSourceReader):
    def __init__(self, path: str, schema, options):
        self.path, self.schema, self.options = path, schema, options

    def partitions(self):
        return [Shard(p) for p, _ in files_of(self.path)]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        system, _ = system_of(self.path)
        made = [(f.name, f.name.encode(), _reading(f.dataType)) for f in self.schema.fields]
        wanted = {name for _, name, _ in made}
        arrow, drop = to_arrow_schema(self.schema), self.options.get("mode", "").lower() == "dropmalformed"
        verify = self.options.get("verify", "true").lower() == "true"
        with system.open_input_stream(partition.path, compression="gzip" if partition.path.endswith(".gz") else None, buffer_size=1 << 20) as stream:
            for records in framed(stream, partition.path, verify, drop):
                rows = [decode(r, wanted) for r in records]
                columns = [[None if (v := r.get(name)) is None else make(v) for r in rows] for _, name, make in made]
                yield pa.RecordBatch.from_arrays([_array(x, t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)


def _array(values: list, kind) -> pa.Array:
    if pa.types.is_timestamp(kind):
        return pa.array(values, pa.int64()).cast(pa.timestamp("us")).cast(kind) if kind.tz is None else pa.array(values, pa.timestamp("us", kind.tz))
    return pa.array(values, kind)


class TfRecordWriter(StagedWriter):
    """A task's rows as one shard, a record each; nulls are left out."""

    def __init__(self, target, overwrite, schema, options):
        super().__init__(target, overwrite)
        self.lists = {f.name for f in schema.fields if _depth(f.dataType) > 1 or options.get("record", "").lower() == "sequenceexample" and _depth(f.dataType)}
        self.sequence = options.get("record", "").lower() == "sequenceexample" or bool(self.lists)
        self.zipped = options.get("compression", "").lower() == "gzip"

    def put(self, batches, system, folder):
        name, rows, stream = f"part-{uuid.uuid4().hex}.tfrecord" + ".gz" * self.zipped, 0, None
        for b in batches:
            columns = {n: _plain(c) for n, c in zip(b.schema.names, b.columns, strict=True)}
            records = []
            for k in range(b.num_rows):
                held = {n: c[k] for n, c in columns.items() if c[k] is not None}
                flat = {n: v if isinstance(v, list) else [v] for n, v in held.items() if n not in self.lists}
                steps = {n: [x if isinstance(x, list) else [x] for x in v] for n, v in held.items() if n in self.lists}
                records.append(encode(flat, steps if self.sequence else None))
            if records:
                stream = stream or system.open_output_stream(f"{folder}/{name}", compression="gzip" if self.zipped else None)
                stream.write(frame(records))
                rows += len(records)
        if stream is None:
            return [], {"rows": 0}
        stream.close()
        return [name], {"rows": rows}


def _plain(column: pa.Array) -> list:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    values = column.to_pylist()
    if pa.types.is_boolean(column.type):
        return [None if v is None else int(v) for v in values]
    return values


class TfRecordSource(DataSource):
    """``spark.dataSource.register(TfRecordSource)``, then ``format("tfrecord").schema(...)``."""

    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        raise ValueError("record files have no schema of their own: give one")

    def reader(self, schema):
        return TfRecordReader(self.options["path"], schema, self.options)

    def writer(self, schema, overwrite):
        return TfRecordWriter(self.options["path"], overwrite, schema, self.options)
