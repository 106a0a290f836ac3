"""Hierarchical array files (HDF5) as steps: ``format("hdf5")``, read and written without a library of that format.

A column is named after its data set, with slashes (```action/gripper_position```); its first axis is the step, what further
axes hold becomes an array.  ``episode_id`` is the name of the file's folder, ``step`` the row, ``file`` the path.  Only the data sets that
the schema names are read, of them only the chunks that hold a partition's steps.  A file of more than PART bytes
is dealt to a partition for each PART of them by ranges of steps; smaller ones share partitions.  Nothing holds a file whole.

What is read: superblocks 0 to 3, object headers 1 and 2, groups by symbol tables or compact links, compact, contiguous and
chunked data (chunk trees, single and implicit chunks), deflate, shuffle and Fletcher-32; integers, floats, enumerations,
strings of fixed and variable length.  Anything else is an error that names the file and the data set.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .staged import StagedWriter, files_of, system_of

PART = 64 << 20
BATCH_STEPS = 4_096
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
# Message kinds of object headers, and filters.
DATASPACE, DATATYPE, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 1, 3, 6, 8, 11, 16, 17
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


class Unreadable(ValueError):
    pass


@dataclass
class Kind:
    """An element: its numpy type, or text of fixed length, or of variable length in global heaps."""

    size: int
    numpy: np.dtype | None
    text: str = ""


@dataclass
class Array:
    """A data set: shape, element, filters (number, client values) and where its bytes are."""

    shape: tuple[int, ...]
    kind: Kind
    filters: list[tuple[int, list[int]]]
    place: tuple  # ("bytes", data), ("run", address), ("tree", address, chunk), ("one", address, size, chunk), ("grid", address, chunk)


class File:
    """A reader of one open file; ``read_at(size, offset)`` is all that it needs of it."""

    def __init__(self, source):
        self.source = source
        self.base = self.root = 0
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise Unreadable("no such file by its first bytes")
        version = head[8]
        if version <= 1:
            sizes, rest = head[13:15], 24 + 4 * version
            self.base, self.root = self._words(head, rest, 1)[0], struct.unpack_from("<Q", self.at(rest + 40, 8))[0]
        elif version <= 3:
            sizes = head[9:11]
            self.base, _, _, self.root = self._words(head, 12, 4)
        else:
            raise Unreadable(f"superblock {version}")
        if bytes(sizes) != b"\x08\x08":
            raise Unreadable("addresses that aren't of 8 bytes")
        self.heaps: dict[int, dict[int, bytes]] = {}

    def at(self, address: int, size: int) -> bytes:
        out = self.source.read_at(size, self.base + address)
        return bytes(out)

    @staticmethod
    def _words(b: bytes, at: int, n: int) -> tuple[int, ...]:
        return struct.unpack_from(f"<{n}Q", b, at)

    # Objects.

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        head = self.at(address, 16)
        out, blocks = [], []
        if head[:4] == b"OHDR":
            flags = head[5]
            skip = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            wide = 1 << (flags & 3)
            size = int.from_bytes(self.at(address + skip, wide), "little")
            blocks.append((address + skip + wide, size))
            while blocks:
                at, size = blocks.pop(0)
                b, k, lead = self.at(at, size), 0, 4 + 2 * bool(flags & 4)
                while k + lead <= len(b):
                    kind, n = b[k], struct.unpack_from("<H", b, k + 1)[0]
                    body, k = b[k + lead : k + lead + n], k + lead + n
                    if kind == CONTINUED:
                        a, n = self._words(body, 0, 2)
                        blocks.append((a + 4, n - 8))
                    else:
                        out.append((kind, body))
            return out
        if head[0] != 1:
            raise Unreadable(f"object header {head[0]}")
        blocks.append((address + 16, struct.unpack_from("<I", head, 8)[0]))
        while blocks:
            at, size = blocks.pop(0)
            b, k = self.at(at, size), 0
            while k + 8 <= len(b):
                kind, n = struct.unpack_from("<HH", b, k)
                body, k = b[k + 8 : k + 8 + n], k + 8 + n
                if kind == CONTINUED:
                    blocks.append(self._words(body, 0, 2))
                else:
                    out.append((kind, body))
        return out

    def links(self, address: int) -> dict[str, int]:
        """The names in a group and their objects' addresses."""
        out: dict[str, int] = {}
        for kind, b in self.messages(address):
            if kind == SYMBOLS:
                tree, heap = self._words(b, 0, 2)
                names = self.at(self._words(self.at(heap, 32), 24, 1)[0], self._words(self.at(heap, 32), 8, 1)[0])
                for node in self._leaves(tree):
                    count = struct.unpack_from("<H", self.at(node, 8), 6)[0]
                    table = self.at(node + 8, 40 * count)
                    for k in range(count):
                        name, to = self._words(table, 40 * k, 2)
                        out[names[name : names.index(b"\0", name)].decode()] = to
            elif kind == LINK:
                flags, k = b[1], 2
                hard = not (flags & 8) or b[k] == 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                wide = 1 << (flags & 3)
                n = int.from_bytes(b[k : k + wide], "little")
                if hard:
                    out[b[k + wide : k + wide + n].decode()] = self._words(b, k + wide + n, 1)[0]
            elif kind == 2 and self._words(b, 2 + 8 * bool(b[1] & 1), 1)[0] != UNDEFINED:
                raise Unreadable("a group with its links in a heap")
        return out

    def _leaves(self, tree: int):
        head = self.at(tree, 24)
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        body = self.at(tree + 24, 8 + 16 * used)
        for k in range(used):
            child = self._words(body, 8 + 16 * k, 1)[0]
            yield from self._leaves(child) if level else [child]

    def find(self, path: str) -> int | None:
        address = self.root
        for name in path.strip("/").split("/"):
            address = self.links(address).get(name)
            if address is None:
                return None
        return address

    def array(self, address: int) -> Array:
        shape, kind, filters, place = (), None, [], None
        for number, b in self.messages(address):
            if number == DATASPACE:
                rank = b[1]
                shape = self._words(b, 8 if b[0] == 1 else 4, rank)
            elif number == DATATYPE:
                kind = self._kind(b)
            elif number == FILTERS:
                filters = self._filters(b)
            elif number == LAYOUT:
                place = self._layout(b)
        if kind is None or place is None:
            raise Unreadable("no data set")
        return Array(shape, kind, filters, place)

    def _kind(self, b: bytes) -> Kind:
        kind, bits, size = b[0] & 15, int.from_bytes(b[1:4], "little"), struct.unpack_from("<I", b, 4)[0]
        order = ">" if bits & 1 else "<"
        if kind == 0:
            return Kind(size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
        if kind == 1:
            return Kind(size, np.dtype(f"{order}f{size}"))
        if kind == 3:
            return Kind(size, None, "fixed")
        if kind == 8:
            return self._kind(b[8:])
        if kind == 9 and bits & 15 == 1:
            return Kind(size, None, "heap")
        raise Unreadable(f"elements of kind {kind}")

    @staticmethod
    def _filters(b: bytes) -> list[tuple[int, list[int]]]:
        out, k = [], 8 if b[0] == 1 else 2
        for _ in range(b[1]):
            number = struct.unpack_from("<H", b, k)[0]
            named = b[0] == 1 or number >= 256
            name = struct.unpack_from("<H", b, k + 2)[0] if named else 0
            values = struct.unpack_from("<H", b, k + 4 + 2 * named)[0]
            k += 6 + 2 * named + (-(-name // 8) * 8 if b[0] == 1 else name)
            out.append((number, list(struct.unpack_from(f"<{values}I", b, k))))
            k += 4 * (values + (values % 2 if b[0] == 1 else 0))
        return out

    def _layout(self, b: bytes) -> tuple:
        version, kind = b[0], b[1]
        if version not in (3, 4):
            raise Unreadable(f"layout {version}")
        if kind == 0:
            n = struct.unpack_from("<H", b, 2)[0]
            return ("bytes", b[4 : 4 + n])
        if kind == 1:
            return ("run", self._words(b, 2, 1)[0])
        if kind == 2 and version == 3:
            rank = b[2] - 1
            return ("tree", self._words(b, 3, 1)[0], struct.unpack_from(f"<{rank}I", b, 11))
        if kind == 2:
            flags, rank, wide = b[2], b[3] - 1, b[4]
            chunk = tuple(int.from_bytes(b[5 + wide * j : 5 + wide * (j + 1)], "little") for j in range(rank))
            k = 5 + wide * (rank + 1)
            if b[k] == 1:
                size = self._words(b, k + 1, 1)[0] if flags & 2 else None
                return ("one", self._words(b, k + 1 + 12 * bool(flags & 2), 1)[0], size, chunk)
            if b[k] == 2:
                return ("grid", self._words(b, k + 1, 1)[0], chunk)
        raise Unreadable("an index of chunks that isn't known")

    # Values.

    def _chunks(self, a: Array, begin: int, end: int):
        """(origin, address, stored size, filters skipped) of the chunks that hold rows of ``begin`` to ``end``."""
        kind, address, *more = a.place
        if kind == "one":
            yield (0,) * len(a.shape), address, more[0], 0
        elif kind == "grid":
            chunk = more[0]
            size, across = int(np.prod(chunk)) * a.kind.size, [-(-n // c) for n, c in zip(a.shape, chunk, strict=True)]
            for row in range(begin // chunk[0], -(-end // chunk[0])):
                for k, rest in enumerate(np.ndindex(*across[1:])):
                    yield tuple(i * c for i, c in zip((row, *rest), chunk, strict=True)), address + (row * int(np.prod(across[1:])) + k) * size, size, 0
        elif address != UNDEFINED:
            yield from self._branches(address, len(a.shape), begin, end, more[0][0])

    def _branches(self, tree: int, rank: int, begin: int, end: int, deep: int):
        head = self.at(tree, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise Unreadable("a broken tree of chunks")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        step = 8 + 8 * (rank + 1)
        body = self.at(tree + 24, (step + 8) * used + step)
        for k in range(used):
            at = k * (step + 8)
            size, skipped = struct.unpack_from("<II", body, at)
            origin = self._words(body, at + 8, rank)
            child = self._words(body, at + step, 1)[0]
            following = self._words(body, at + step + 16, 1)[0]
            if level:
                if origin[0] < end and (k == used - 1 or following + deep > begin):
                    yield from self._branches(child, rank, begin, end, deep)
            elif origin[0] < end and origin[0] + deep > begin:
                yield origin, child, size, skipped

    @staticmethod
    def _unfiltered(b: bytes, a: Array, skipped: int) -> bytes:
        for k in range(len(a.filters) - 1, -1, -1):
            number, values = a.filters[k]
            if skipped >> k & 1:
                continue
            if number == DEFLATE:
                b = zlib.decompress(b)
            elif number == SHUFFLE:
                size = values[0] if values else a.kind.size
                n = len(b) // size
                b = np.frombuffer(b, np.uint8, n * size).reshape(size, n).T.tobytes() + b[n * size :]
            elif number == FLETCHER:
                b = b[:-4]
            else:
                raise Unreadable(f"filter {number}")
        return b

    def rows(self, a: Array, begin: int, end: int) -> np.ndarray:
        """Elements of rows ``begin`` to ``end``; what was never written is zero."""
        kind, *more = a.place
        element = a.kind.numpy or np.dtype(f"V{a.kind.size}")
        width = int(np.prod(a.shape[1:], dtype=np.int64)) * element.itemsize
        shape = (end - begin, *a.shape[1:])
        if kind == "bytes":
            return np.frombuffer(more[0], element, (end - begin) * (width // element.itemsize), begin * width).reshape(shape)
        if kind == "run":
            if more[0] == UNDEFINED:
                return np.zeros(shape, element)
            return np.frombuffer(self.at(more[0] + begin * width, (end - begin) * width), element).reshape(shape)
        out, chunk = np.zeros(shape, element), more[-1]
        for origin, address, size, skipped in self._chunks(a, begin, end):
            raw = self._unfiltered(self.at(address, int(np.prod(chunk)) * element.itemsize if size is None else size), a, skipped)
            block = np.frombuffer(raw, element, int(np.prod(chunk))).reshape(chunk)
            low = [max(o, begin) if j == 0 else o for j, o in enumerate(origin)]
            high = [min(o + c, end if j == 0 else n) for j, (o, c, n) in enumerate(zip(origin, chunk, a.shape, strict=True))]
            if low[0] < high[0]:
                to = tuple(slice(x - begin * (j == 0), y - begin * (j == 0)) for j, (x, y) in enumerate(zip(low, high, strict=True)))
                out[to] = block[tuple(slice(x - o, y - o) for x, y, o in zip(low, high, origin, strict=True))]
        return out

    def values(self, a: Array, begin: int, end: int) -> list:
        """Rows as Python values: a number or text, or a flat list where a row has further axes."""
        raw = self.rows(a, begin, end)
        if a.kind.text:
            made = [self._text(x.tobytes(), a.kind) for x in raw.reshape(-1)]
            width = int(np.prod(a.shape[1:], dtype=np.int64))
            return made if len(a.shape) < 2 else [made[k : k + width] for k in range(0, len(made), width)] if width else [[] for _ in range(end - begin)]
        native = raw.astype(raw.dtype.newbyteorder("="))
        return native.tolist() if native.ndim < 2 else native.reshape(len(native), -1).tolist()

    def _text(self, b: bytes, kind: Kind) -> str:
        if kind.text == "fixed":
            return b.split(b"\0", 1)[0].decode("utf-8", "replace")
        size, address, index = struct.unpack("<IQI", b)
        if not size:
            return ""
        if address not in self.heaps:
            if len(self.heaps) > 64:
                self.heaps.clear()
            self.heaps[address] = self._heap(address)
        return self.heaps[address][index][:size].decode("utf-8", "replace")

    def _heap(self, address: int) -> dict[int, bytes]:
        whole = self.at(address, self._words(self.at(address, 16), 8, 1)[0])
        out, k = {}, 16
        while k + 16 <= len(whole):
            index, size = struct.unpack_from("<H", whole, k)[0], self._words(whole, k + 8, 1)[0]
            if not index:
                break
            out[index] = whole[k + 16 : k + 16 + size]
            k += 16 + -(-size // 8) * 8
        return out


# The source.


class Part(InputPartition):
    """Files with the share of their steps, from ``k / of`` to ``(k + 1) / of``."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(pieces)
        self.pieces = pieces


def parts_of(files: list[tuple[str, int]], size: int = PART) -> list[Part]:
    out, held, room = [], [], 0
    for path, n in files:
        if n > size:
            of = -(-n // size)
            out += [Part([(path, k, of)]) for k in range(of)]
        else:
            if held and room + n > size:
                out.append(Part(held))
                held, room = [], 0
            held.append((path, 0, 1))
            room += n
    return [*out, Part(held)] if held else out


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, schema, options):
        self.path, self.schema, self.options = path, schema, options

    def partitions(self):
        return parts_of([x for x in files_of(self.path) if x[0].endswith((".h5", ".hdf5"))], int(self.options.get("partBytes", PART)))

    def read(self, partition):
        if partition is None:  # no file at all
            return
        system, _ = system_of(self.path)
        arrow = to_arrow_schema(self.schema)
        for path, k, of in partition.pieces:
            with system.open_input_file(path) as source:
                try:
                    yield from self._steps(File(source), path, k, of, arrow)
                except (Unreadable, zlib.error, struct.error, IndexError, UnicodeDecodeError) as e:
                    raise Unreadable(f"{path}: {e}") from e

    def _steps(self, file: File, path: str, k: int, of: int, arrow):
        own = {"episode_id": path.split("/")[-2] if "/" in path else path, "file": path}
        arrays = {}
        for f in self.schema.fields:
            if f.name not in (*own, "step"):
                at = file.find(f.name)
                arrays[f.name] = None if at is None else file.array(at)
        sizes = {a.shape[0] for a in arrays.values() if a is not None and a.shape}
        if len(sizes) > 1:
            raise Unreadable(f"data sets of different lengths {sorted(sizes)}")
        n = max(sizes, default=0)
        for begin in range(n * k // of, n * (k + 1) // of, BATCH_STEPS):
            end = min(begin + BATCH_STEPS, n * (k + 1) // of)
            columns = []
            for f, to in zip(self.schema.fields, arrow, strict=True):
                if f.name == "step":
                    values = list(range(begin, end))
                elif f.name in own:
                    values = [own[f.name]] * (end - begin)
                elif arrays[f.name] is None:
                    values = [None] * (end - begin)
                else:
                    a = arrays[f.name]
                    values = file.values(a, begin, end) if a.shape else file.values(Array((1,), a.kind, a.filters, a.place), 0, 1) * (end - begin)
                    if isinstance(f.dataType, T.ArrayType) and len(a.shape) < 2:
                        values = [[x] for x in values]
                    elif not isinstance(f.dataType, T.ArrayType) and len(a.shape) > 1:
                        values = [x[0] if x else None for x in values]
                columns.append(pa.array(values).cast(to.type) if values and values[0] is not None else pa.nulls(end - begin, to.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


# Writing: superblock 0, symbol tables, chunked data sets.


def _object(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<HHB3x", kind, -(-len(b) // 8) * 8, 0) + b + b"\0" * (-len(b) % 8) for kind, b in messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _numbers(a: np.ndarray) -> tuple[np.ndarray, bytes]:
    if a.dtype.kind == "f":
        a = a.astype("<f8")
        return a, struct.pack("<B3BI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    if a.dtype.kind in "iub":
        return a.astype("<i8"), struct.pack("<B3BI", 0x10, 8, 0, 0, 8) + struct.pack("<HH", 0, 64)
    a = np.array([str(x).encode() for x in a.reshape(-1)]).reshape(a.shape)
    a = a.astype(f"S{max(a.dtype.itemsize, 1)}")
    return a, struct.pack("<B3BI", 0x13, 0x11, 0, 0, a.dtype.itemsize)


def file_bytes(arrays: dict[str, np.ndarray], chunk: int = 256, filters: tuple[int, ...] = (SHUFFLE, DEFLATE)) -> bytes:
    """A file with ``arrays`` by path, in chunks of ``chunk`` rows."""
    out = bytearray(96)

    def put(b: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def data(a: np.ndarray) -> int:
        a, kind = _numbers(a)
        rows, shape = min(chunk, max(len(a), 1)), a.shape
        keys = []
        for k in range(0, len(a), rows):
            block = np.zeros((rows, *shape[1:]), a.dtype)
            block[: len(a[k : k + rows])] = a[k : k + rows]
            b = block.tobytes()
            for f in filters:
                b = np.frombuffer(b, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if f == SHUFFLE else zlib.compress(b) if f == DEFLATE else b
            keys.append((struct.pack("<II", len(b), 0) + struct.pack(f"<{len(shape) + 1}Q", k, *[0] * len(shape)), put(b)))
        level, nodes = 0, keys
        while True:  # 64 children a node, and a leaf at least
            groups = [nodes[k : k + 64] for k in range(0, len(nodes), 64)] or [[]]
            after = struct.pack("<II", 0, 0) + struct.pack(f"<{len(shape) + 1}Q", -(-len(a) // rows) * rows, *[0] * len(shape))
            made = []
            for j, g in enumerate(groups):
                body = b"".join(key + struct.pack("<Q", at) for key, at in g) + (groups[j + 1][0][0] if j + 1 < len(groups) else after)
                made.append((g[0][0] if g else after, put(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(g), UNDEFINED, UNDEFINED) + body)))
            level, nodes = level + 1, made
            if len(nodes) == 1:
                break
        pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", f, 0, 0, 1, a.dtype.itemsize if f == SHUFFLE else 6, 0) for f in filters)
        layout = struct.pack("<BBBQ", 3, 2, len(shape) + 1, nodes[0][1]) + struct.pack(f"<{len(shape) + 1}I", rows, *shape[1:], a.dtype.itemsize)
        space = struct.pack("<BBBx4x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)
        return put(_object([(DATASPACE, space), (DATATYPE, kind), *([(FILTERS, pipeline)] if filters else []), (LAYOUT, layout)]))

    def group(members: dict) -> int:
        names, entries = b"\0" * 8, []
        for name in sorted(members):
            entries.append((len(names), data(members[name]) if isinstance(members[name], np.ndarray) else group(members[name])))
            names += name.encode() + b"\0" * (8 - len(name.encode()) % 8)
        heap = put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), UNDEFINED, put(names)))
        table = put(struct.pack("<4sBxH", b"SNOD", 1, len(entries)) + b"".join(struct.pack("<QQII16x", at, to, 0, 0) for at, to in entries))
        tree = put(struct.pack("<4sBBHQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, table, entries[-1][0] if entries else 0))
        return put(_object([(SYMBOLS, struct.pack("<QQ", tree, heap))]))

    top: dict = {}
    for path, a in arrays.items():
        *folders, name = path.split("/")
        at = top
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = a
    root = group(top)
    out[:96] = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 512, 16, 0) + struct.pack("<4Q", 0, UNDEFINED, len(out), UNDEFINED) + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out)


class Hdf5Writer(StagedWriter):
    """A row an episode: ``episode_id``, and data sets as arrays with an entry a step; written to <target>/<episode_id>/trajectory.h5."""

    def put(self, batches, system, folder):
        names, steps = [], 0
        for b in batches:
            for r in b.to_pylist():
                name = str(r.pop("episode_id"))
                arrays = {k: np.array(v) for k, v in r.items() if v is not None and len(v)}
                system.create_dir(f"{folder}/{name}", recursive=True)
                with system.open_output_stream(f"{folder}/{name}/trajectory.h5") as f:
                    f.write(file_bytes(arrays))
                names.append(f"{name}/trajectory.h5")
                steps += max(map(len, arrays.values()), default=0)
        return names, {"episodes": len(names), "steps": steps}


class Hdf5Source(DataSource):
    """``spark.dataSource.register(Hdf5Source)``, then ``format("hdf5").schema(...)``."""

    @classmethod
    def name(cls):
        return "hdf5"

    def schema(self):
        raise ValueError("give a schema: its columns are the data sets to read")

    def reader(self, schema):
        return Hdf5Reader(self.options["path"], schema, self.options)

    def writer(self, schema, overwrite):
        return Hdf5Writer(self.options["path"], overwrite)
