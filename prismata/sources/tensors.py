"""Named tensors in checkpoint files: safetensors files and zipped pickles, read by byte ranges, written by tasks.

A Python data source plans the scan: of each file it reads the header, or the
zip directory and the pickle, and deals the tensors' bytes into ranges. A task
opens the file at its range and reads no more. Large tensors come in several
rows, so that no row and no task holds more than a piece.

The pickle of a checkpoint is never executed: its op codes are interpreted here,
names of modules are nothing but strings, and any name that isn't one of a few
fixed ones makes the file an error row.
"""

from __future__ import annotations

import json
import math
import pickletools
import struct
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

#: Element types by their name in headers, as numpy reads them; BF16 is the upper half of F32.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}
#: Storage classes in pickles, and the element types they hold.
STORAGES = {"DoubleStorage": "F64", "FloatStorage": "F32", "HalfStorage": "F16", "BFloat16Storage": "BF16", "LongStorage": "I64",
            "IntStorage": "I32", "ShortStorage": "I16", "CharStorage": "I8", "ByteStorage": "U8", "BoolStorage": "BOOL"}
#: The other names a checkpoint's pickle may have.
REBUILD, REBUILD_PARAMETER, ORDERED = "torch._utils _rebuild_tensor_v2", "torch._utils _rebuild_parameter", "collections OrderedDict"

SCHEMA = "file string, name string, dtype string, shape array<bigint>, start bigint, data array<double>, whole array<bigint>, error string"
#: Bytes of a range that one task reads, and of a row's piece of a tensor; a header beyond the last is an error.
RANGE_BYTES, PIECE_BYTES, HEADER_BYTES = 64 << 20, 4 << 20, 100 << 20


class Refused(ValueError):
    """What a file holds is not read."""


def width(dtype: str) -> int:
    return np.dtype(KINDS[dtype]).itemsize


def values(dtype: str, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, KINDS[dtype])
    return (x.astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else x


def stored(dtype: str, x) -> bytes:
    """Numbers as bytes of a type; those of BF16 go to the nearest, ties to the even one."""
    if dtype != "BF16":
        return np.asarray(x).astype(KINDS[dtype]).tobytes()
    bits = np.asarray(x, np.float32).view(np.uint32).astype(np.uint64)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2").tobytes()


# ---- headers


def safetensors_entries(file, size: int) -> list[tuple]:
    """``name, dtype, shape, byte offset, strides`` of the tensors of a safetensors file; strides are null for plain order."""
    n = int.from_bytes(file.read(8), "little") if size >= 8 else -1
    if not 0 < n <= min(size - 8, HEADER_BYTES):
        raise Refused("the length of the header is beyond the file")
    try:
        header = json.loads(file.read(n))
        held = [(name, t["dtype"], [int(k) for k in t["shape"]], *map(int, t["data_offsets"])) for name, t in header.items() if name != "__metadata__"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Refused(f"the header can't be read: {e}") from e
    at = 0
    for name, dtype, shape, a, b in sorted(held, key=lambda t: (t[3], t[4])):
        if dtype not in KINDS:
            raise Refused(f"{name!r} has the unknown type {dtype!r}")
        if a < at or b - a != math.prod(shape) * width(dtype) or 8 + n + b > size or min(shape, default=0) < 0:
            raise Refused(f"the range of {name!r} does not fit")
        at = b
    return [(name, dtype, shape, 8 + n + a, None) for name, dtype, shape, a, _ in held]


def pickled(data: bytes):
    """What a pickle describes, as dicts, lists, tuples and plain values, without running any of it.

    A call is ``("call", name, arguments)`` and a persistent id ``("held", id)``;
    only names of the fixed list occur.
    """
    stack, marks, memo = [], [], {}

    def name(text: str) -> tuple:
        module, _, attribute = text.partition(" ")
        if text not in (REBUILD, REBUILD_PARAMETER, ORDERED) and not (module == "torch" and attribute in STORAGES):
            raise Refused(f"the name {text!r} is not allowed")
        return ("name", text)

    def popped() -> list:
        at = marks.pop()
        out = stack[at:]
        del stack[at:]
        return out

    def pairs(items: list) -> None:
        for k, v in zip(items[::2], items[1::2], strict=True):
            stack[-1][k] = v

    for code, argument, _ in pickletools.genops(data):
        op = code.name
        if op in ("PROTO", "FRAME"):
            continue
        if op == "STOP":
            return stack.pop()
        if op == "MARK":
            marks.append(len(stack))
        elif op in ("BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "BININT", "BININT1", "BININT2", "INT", "LONG1", "BINFLOAT"):
            stack.append(argument)
        elif op in ("NONE", "NEWTRUE", "NEWFALSE"):
            stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[op])
        elif op in ("EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE"):
            stack.append({"EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple}[op]())
        elif op == "TUPLE":
            stack.append(tuple(popped()))
        elif op in ("TUPLE1", "TUPLE2", "TUPLE3"):
            k = int(op[-1])
            stack[-k:] = [tuple(stack[-k:])]
        elif op == "SETITEM":
            v = stack.pop()
            pairs([stack.pop(), v])
        elif op == "SETITEMS":
            pairs(popped())
        elif op == "APPEND":
            v = stack.pop()
            stack[-1].append(v)
        elif op == "APPENDS":
            items = popped()
            stack[-1].extend(items)
        elif op in ("BINPUT", "LONG_BINPUT"):
            memo[argument] = stack[-1]
        elif op == "MEMOIZE":
            memo[len(memo)] = stack[-1]
        elif op in ("BINGET", "LONG_BINGET"):
            stack.append(memo[argument])
        elif op == "GLOBAL":
            stack.append(name(argument))
        elif op == "STACK_GLOBAL":
            attribute = stack.pop()
            stack.append(name(f"{stack.pop()} {attribute}"))
        elif op == "BINPERSID":
            stack.append(("held", stack.pop()))
        elif op == "REDUCE":
            arguments, called = stack.pop(), stack.pop()
            if not (isinstance(called, tuple) and called[:1] == ("name",)):
                raise Refused("a call of something without a name")
            stack.append({} if called[1] == ORDERED else ("call", called[1], arguments))
        elif op == "BUILD":
            stack.pop()  # attributes of a dict, such as versions of modules
        elif op == "POP":
            stack.pop()
        else:
            raise Refused(f"the op code {op} is not allowed")
    raise Refused("the pickle has no end")


def _tensors(found, left: list[int], path: str = "", depth: int = 0) -> Iterator[tuple]:
    """``name, storage key, dtype, offset, shape, strides`` of the tensors in nested dicts and lists, names joined by dots.

    ``left`` counts down from the length of the pickle: only one that refers to
    the same parts again and again, or to itself, has more parts than bytes.
    """
    left[0] -= 1
    if left[0] < 0 or depth > 100:
        raise Refused("the pickle's parts hold each other too often")
    if isinstance(found, dict | list):
        for k, v in found.items() if isinstance(found, dict) else enumerate(found):
            yield from _tensors(v, left, f"{path}.{k}" if path else str(k), depth + 1)
    elif isinstance(found, tuple) and found[:1] == ("call",):
        called, arguments = found[1:]
        if called == REBUILD_PARAMETER:
            yield from _tensors(arguments[0], left, path, depth + 1)
        else:
            (_, (_, (_, storage), key, *_)), offset, shape, strides = arguments[:4]
            yield path, str(key), STORAGES[storage.partition(" ")[2]], int(offset), [int(k) for k in shape], [int(k) for k in strides]


def pickle_entries(file, size: int) -> list[tuple]:
    """The same of a zipped pickle: only the zip's directory, the pickle and the heads of members are read."""
    try:
        with zipfile.ZipFile(file) as z:
            members = {m.filename: m for m in z.infolist()}
            main = next((m for m in members if m.rpartition("/")[2] == "data.pkl"), None)
            if main is None:
                raise Refused("the archive has no data.pkl")
            if members[main].file_size > HEADER_BYTES:
                raise Refused("the pickle is too long")
            root = main.rpartition("/")[0]
            order = f"{root}/byteorder".lstrip("/")
            if order in members and z.read(order) != b"little":
                raise Refused("the numbers are not little-endian")
            data = z.read(main)
            held = list(_tensors(pickled(data), [len(data)]))
    except (zipfile.BadZipFile, ValueError, KeyError, IndexError, TypeError, AttributeError, OSError, NotImplementedError) as e:
        raise e if isinstance(e, Refused) else Refused(f"the archive can't be read: {e}") from e
    at: dict[str, tuple[int, int]] = {}
    out = []
    for name, key, dtype, offset, shape, strides in held:
        member = members.get(f"{root}/data/{key}".lstrip("/"))
        if member is None or member.compress_type != zipfile.ZIP_STORED:
            raise Refused(f"the numbers of {name!r} are not there, or compressed")
        if key not in at:
            file.seek(member.header_offset)
            head = file.read(30)
            if head[:4] != b"PK\3\4":
                raise Refused("a member has no head")
            at[key] = member.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])), member.file_size
        begin, length = at[key]
        if min([*shape, *strides, offset], default=0) < 0 or len(shape) != len(strides):
            raise Refused(f"the shape of {name!r} does not fit")
        last = offset + sum((n - 1) * s for n, s in zip(shape, strides, strict=True)) if math.prod(shape) else offset - 1
        if (last + 1) * width(dtype) > length:
            raise Refused(f"the range of {name!r} does not fit")
        out.append((name, dtype, shape, begin + offset * width(dtype), None if strides == plain_strides(shape) or math.prod(shape) <= 1 else strides))
    return out


def plain_strides(shape: list[int]) -> list[int]:
    return [math.prod(shape[i + 1 :]) for i in range(len(shape))]


# ---- the data source


class Range(InputPartition):
    """Pieces of a file's tensors, ``name, dtype, shape, byte offset, strides, first number, numbers``, or why it isn't read."""

    def __init__(self, file: str, pieces: list[tuple], error: str | None = None):
        self.file, self.pieces, self.error = file, pieces, error


def planned(path: str, entries: list[tuple], range_bytes: int = RANGE_BYTES, piece_bytes: int = PIECE_BYTES) -> list[Range]:
    """Ranges of at most ``range_bytes``, in the order of the file; a tensor in plain order is cut into pieces."""
    pieces = []
    for name, dtype, shape, at, strides in sorted(entries, key=lambda t: t[3]):
        total, most = math.prod(shape), max(1, piece_bytes // width(dtype))
        if strides is not None:
            pieces.append((name, dtype, shape, at, strides, 0, total))
            continue
        for k in range(0, max(total, 1), most):
            pieces.append((name, dtype, shape, at + k * width(dtype), None, k, min(most, total - k)))
    out, held = [], 0
    for p in pieces:
        size = p[6] * width(p[1])
        if not out or held + size > range_bytes:
            out.append(Range(path, []))
            held = 0
        out[-1].pieces.append(p)
        held += size
    return out


class TensorReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes, self.piece_bytes = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("piecebytes", PIECE_BYTES))

    def partitions(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]

        def plan(f) -> list[Range]:
            try:
                with system.open_input_file(f.path) as file:
                    start = file.read(4)
                    file.seek(0)
                    entries = (pickle_entries if start[:2] == b"PK" else safetensors_entries)(file, f.size)
                return planned(f.path, entries, self.range_bytes, self.piece_bytes)
            except Refused as e:
                return [Range(f.path, [], str(e))]

        with ThreadPoolExecutor(16) as pool:
            ranges = [r for plans in pool.map(plan, sorted(found, key=lambda f: f.path)) for r in plans]
        return ranges or [Range("", [])]

    def read(self, partition):
        from pyarrow import fs

        names = ["file", "name", "dtype", "shape", "start", "data", "whole", "error"]

        def row(name=None, dtype=None, shape=None, start=None, x=None, error=None):
            real = x is not None and x.dtype.kind == "f"
            one = [partition.file.rpartition("/")[2], name, dtype, shape, start, x.astype(np.float64) if real else None, None if x is None or real else x.astype(np.int64), error]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names)

        if partition.error is not None:
            yield row(error=partition.error)
        if not partition.pieces:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as file:
            for name, dtype, shape, at, strides, start, n in partition.pieces:
                file.seek(at)
                size = width(dtype)
                if strides is None:
                    x = values(dtype, file.read(n * size))
                else:
                    span = 1 + sum((k - 1) * s for k, s in zip(shape, strides, strict=True))
                    x = values(dtype, file.read(span * size))
                    x = np.lib.stride_tricks.as_strided(x, shape, [s * x.itemsize for s in strides]).ravel()
                yield row(name, dtype, shape, start, x)


class TensorSource(DataSource):
    """``spark.read.format("tensors").load(path)``: the tensors of a file, or of all files below a folder.

    A row is a piece of a tensor: its file, name, type and shape, the place of its
    first number, and its numbers, in ``data`` for floating-point types and in
    ``whole`` for integers and booleans. Files that can't be read give a row with
    an ``error``. A tensor without numbers has one row. Options ``rangeBytes`` and
    ``pieceBytes`` bound what a task and a row hold; only a tensor of a pickle that
    isn't stored in plain order comes as one row.
    """

    @classmethod
    def name(cls):
        return "tensors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TensorReader(self.options)


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The tensors below ``path``, a URI of any file system that Arrow knows."""
    ship(spark)
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensors")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


# ---- files written by tasks


def safetensors_header(tensors: list[tuple[str, str, list[int]]]) -> bytes:
    """The head of a file with ``name, dtype, shape`` of its tensors, in the order in which their bytes follow."""
    header, at = {}, 0
    for name, dtype, shape in tensors:
        end = at + math.prod(shape) * width(dtype)
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, end]}
        at = end
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text


def _text(s: str) -> bytes:
    data = s.encode()
    return b"X" + struct.pack("<I", len(data)) + data


def _number(n: int) -> bytes:
    data = n.to_bytes(n.bit_length() // 8 + 1, "little", signed=True)
    return b"\x8a" + bytes([len(data)]) + data


def _tuple(items: list[bytes]) -> bytes:
    return b"(" + b"".join(items) + b"t"


def pickle_of(tensors: list[tuple[str, str, list[int]]]) -> bytes:
    """The pickle of a dict of tensors in plain order, each with a storage of its own, numbered in order."""
    classes = {v: k for k, v in STORAGES.items()}
    body = b""
    for k, (name, dtype, shape) in enumerate(tensors):
        storage = _tuple([_text("storage"), f"ctorch\n{classes[dtype]}\n".encode(), _text(str(k)), _text("cpu"), _number(math.prod(shape))]) + b"Q"
        hooks = b"ccollections\nOrderedDict\n)R"
        rebuilt = [storage, _number(0), _tuple([_number(n) for n in shape]), _tuple([_number(n) for n in plain_strides(shape)]), b"\x89", hooks]
        body += _text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n" + _tuple(rebuilt) + b"R"
    return b"\x80\x02}(" + body + b"u."


class _Plain:
    """A safetensors file being written: its header, then the bytes of one tensor after another."""

    def __init__(self, out, tensors):
        self.out = out
        out.write(safetensors_header(tensors))

    def add(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()


class _Zipped:
    """A zipped pickle being written."""

    def __init__(self, out, tensors):
        self.out, self.zip, self.k = out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
        self.zip.writestr(zipfile.ZipInfo("archive/data.pkl"), pickle_of(tensors))
        self.zip.writestr(zipfile.ZipInfo("archive/byteorder"), b"little")

    def add(self, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(f"archive/data/{self.k}"), data)
        self.k += 1

    def close(self) -> None:
        self.zip.close()
        self.out.close()


LAYOUTS = {"safetensors": _Plain, "pickle": _Zipped}


def write(rows: DataFrame, root: str, layout: str) -> int:
    """Write ``file, name, dtype, shape, data`` (arrays of doubles) as files below ``root``; gives the number of files.

    A file's rows meet in one task, which writes its head and then one tensor
    after another as they come, sorted by name; it holds the names of a file, but
    the numbers of one tensor only. A task that runs twice writes the same files
    again. Two tensors of one name in a file are an error.
    """
    ship(rows.sparkSession)
    make = LAYOUTS[layout]
    heads = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", "dtype", "shape"))).alias("head"))
    both = rows.select("file", "name", "dtype", "data").unionByName(heads, allowMissingColumns=True)
    held = both.repartition("file").sortWithinPartitions("file", F.col("head").isNull(), "name")

    def work(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        out, n = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                file, _, dtype, data, head = (c[i] for c in batch.columns)
                if head.is_valid:
                    tensors = [(t["name"], t["dtype"], t["shape"]) for t in head.as_py()]
                    if len({t[0] for t in tensors}) < len(tensors):
                        raise ValueError(f"{file} has two tensors of one name")
                    if out is not None:
                        out.close()
                    full = f"{base}/{file}"
                    system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                    out, n = make(system.open_output_stream(full), tensors), n + 1
                else:
                    out.add(stored(dtype.as_py(), data.values.to_numpy(zero_copy_only=False)))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return held.mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0
