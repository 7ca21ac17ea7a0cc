"""Checkpoint files: round trips, files of another writer, ranges and pieces, and files that are refused."""

import io
import json
import pickle
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest

from prismata.sources import tensors as T

KINDS = ["F64", "F32", "F16", "BF16", "I64", "I32", "I16", "I8", "U8", "BOOL"]


def joined(df):
    """Tensors by file and name, put together from their pieces."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["file"], r["name"] or "", r["start"] or 0)):
        held = out.setdefault((r["file"], r["name"]), [r["dtype"], r["shape"], [], r["error"]])
        held[2] += r["data"] if r["data"] is not None else r["whole"] or []
    return out


def made_rows():
    g = np.random.default_rng(1)
    out = []
    for k in range(30):
        dtype, shape = KINDS[k % 10], [(3, 4), (5,), (), (0, 2), (1000,)][k % 5]
        n = int(np.prod(shape))
        x = g.integers(0, 2, n) if dtype == "BOOL" else g.integers(0, 100, n) if dtype[0] in "IU" else g.integers(-64, 64, n) / 8
        out.append((f"part/{k % 4}.bin", f"layer.{k}.weight", dtype, list(shape), [float(v) for v in x]))
    return out


@pytest.mark.parametrize("layout", ["safetensors", "pickle"])
def test_what_tasks_write_is_read_back(spark, tmp_path, layout):
    rows = made_rows()
    df = spark.createDataFrame(rows, "file string, name string, dtype string, shape array<long>, data array<double>").repartition(5)
    assert T.write(df, f"file://{tmp_path}", layout) == 4
    want = {(f.rpartition("/")[2], name): [dtype, shape, data, None] for f, name, dtype, shape, data in rows}
    for options in ({}, {"rangeBytes": 512, "pieceBytes": 256}):
        found = T.read(spark, f"file://{tmp_path}", **options)
        assert joined(found) == want
        if options:
            assert found.rdd.getNumPartitions() > 20
            assert all(len(r["data"] or r["whole"] or []) * T.width(r["dtype"]) <= 256 for r in found.collect())
    one = T.read(spark, f"file://{tmp_path}/part/0.bin").select("name", "shape")
    assert one.distinct().count() == sum(r[0] == "part/0.bin" for r in rows)


def test_only_the_ranges_of_a_task_are_read(tmp_path):
    """The planner reads the head; a reader's requests stay inside its range."""
    n = 50_000
    path = tmp_path / "x.safetensors"
    path.write_bytes(T.safetensors_header([("a", "F64", [n]), ("b", "F32", [n])]) + np.arange(n, dtype="<f8").tobytes() + np.arange(n, dtype="<f4").tobytes())
    reader = T.TensorReader({"path": f"file://{path}", "rangebytes": "100000", "piecebytes": "50000"})
    ranges = reader.partitions()
    assert len(ranges) == 6 and all(sum(p[6] * T.width(p[1]) for p in r.pieces) <= 100_000 for r in ranges)
    got = [b.to_pylist()[0] for r in ranges for b in reader.read(r)]
    for name in "ab":
        assert sum((x["data"] for x in sorted((x for x in got if x["name"] == name), key=lambda x: x["start"])), []) == list(map(float, range(n)))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, k=-1):
            out = super().read(k)
            Counted.taken += len(out)
            return out

    T.safetensors_entries(Counted(path.read_bytes()), path.stat().st_size)
    assert Counted.taken < 1000


class _Storage:
    def __init__(self, kind, key, n):
        self.kind, self.key, self.n = kind, key, n


class _Tensor:
    def __init__(self, storage, offset, shape, strides):
        self.parts = (storage, offset, shape, strides)


def saved(found, arrays, protocol=2, members=None):
    """A zipped pickle made by Python's own pickler, as another program writes it."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for kind in T.STORAGES:
        setattr(torch, kind, type(kind, (), {"__module__": "torch", "__qualname__": kind}))

    def rebuild(*a):
        raise AssertionError("ran code")

    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    sys.modules["torch"], sys.modules["torch._utils"] = torch, utils

    class Pickler(pickle.Pickler):
        def persistent_id(self, o):
            if isinstance(o, _Storage):
                return ("storage", getattr(torch, o.kind), o.key, "cpu", o.n)

        def reducer_override(self, o):
            if isinstance(o, _Tensor):
                return rebuild, (*o.parts, False, OrderedDict())
            return NotImplemented

    try:
        held = io.BytesIO()
        Pickler(held, protocol).dump(found)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("model/data.pkl", held.getvalue())
        for k, x in arrays.items():
            z.writestr(f"model/data/{k}", x.tobytes())
        for k, x in (members or {}).items():
            z.writestr(k, x)
    return out.getvalue()


@pytest.mark.parametrize("protocol", [2, 4])
def test_pickles_of_another_writer(spark, tmp_path, protocol):
    x = np.arange(24, dtype="<f4")
    a, b = _Storage("FloatStorage", "0", 24), _Storage("LongStorage", "1", 3)
    found = {"model": OrderedDict(w=_Tensor(a, 0, (4, 6), (6, 1)), turned=_Tensor(a, 2, (3, 2), (1, 6)), tail=_Tensor(a, 20, (4,), (1,))), "n": _Tensor(b, 0, (3,), (1,)),
             "epoch": 7, "rate": 1e-4, "names": ["a", ("b", None)], "on": True, "many": [_Tensor(b, 1, (), ())]}
    (tmp_path / "a.pth").write_bytes(saved(found, {"0": x, "1": np.array([5, 2**60 + 1, -7], "<i8")}, protocol))
    got = {k[1]: v for k, v in joined(T.read(spark, f"file://{tmp_path}")).items()}
    assert got["model.w"] == ["F32", [4, 6], list(map(float, range(24))), None]
    assert got["model.turned"] == ["F32", [3, 2], [2, 8, 3, 9, 4, 10], None] and got["model.tail"][2] == [20, 21, 22, 23]
    assert got["n"] == ["I64", [3], [5, 2**60 + 1, -7], None] and got["many.0"] == ["I64", [], [2**60 + 1], None] and len(got) == 5


class _Bad:
    def __reduce__(self):
        return eval, ("open('/tmp/prismata-ran', 'w')",)


def refused_files():
    head = lambda h, data=b"": (lambda t: len(t).to_bytes(8, "little") + t + data)(json.dumps(h).encode())
    tensor = lambda **k: {"dtype": "F32", "shape": [2], "data_offsets": [0, 8], **k}
    nested = []
    nested.append(nested)
    deep = [[]]
    for _ in range(60):
        deep = [deep, deep]
    a = _Storage("FloatStorage", "0", 4)
    big = np.zeros(4, "<f4")
    return {
        "short.safetensors": b"abc", "empty.safetensors": b"", "long.safetensors": (10**9).to_bytes(8, "little") + b"{}", "text.safetensors": (4).to_bytes(8, "little") + b"{..}",
        "list.safetensors": head([1]), "type.safetensors": head({"a": tensor(dtype="F7")}, b"x" * 8), "range.safetensors": head({"a": tensor(data_offsets=[0, 7])}, b"x" * 8),
        "beyond.safetensors": head({"a": tensor()}, b"x" * 7), "over.safetensors": head({"a": tensor(), "b": tensor(data_offsets=[4, 12])}, b"x" * 12), "minus.safetensors": head({"a": tensor(shape=[-2])}, b"x" * 8),
        "code.pth": saved({"a": _Bad()}, {}), "self.pth": saved(nested, {}), "deep.pth": saved(deep, {}), "cut.pth": saved({}, {})[:60], "nothing.pth": saved({"a": _Tensor(a, 0, (2,), (1,))}, {}),
        "wide.pth": saved({"a": _Tensor(a, 0, (2, 4), (4, 1))}, {"0": big}), "before.pth": saved({"a": _Tensor(a, 3, (2,), (-1,))}, {"0": big}), "order.pth": saved({}, {}, members={"model/byteorder": b"big"}),
        "set.pth": saved({"a": {1, 2}}, {}, 4),
    }


def test_files_that_are_refused_are_error_rows(spark, tmp_path):
    files = refused_files()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "good.safetensors").write_bytes(T.safetensors_header([("a", "F32", [1])]) + np.ones(1, "<f4").tobytes())
    got = T.read(spark, f"file://{tmp_path}").collect()
    assert {r["file"] for r in got if r["error"]} == set(files) and [r["name"] for r in got if not r["error"]] == ["a"]
    said = {r["file"]: r["error"] for r in got}
    assert "eval" in said["code.pth"] and "each other" in said["self.pth"] and "each other" in said["deep.pth"] and "not allowed" in said["set.pth"]
    assert "F7" in said["type.safetensors"] and "fit" in said["wide.pth"]
    import os

    assert not os.path.exists("/tmp/prismata-ran")


def test_an_empty_folder_has_no_tensors_and_equal_names_are_an_error(spark, tmp_path):
    assert T.read(spark, f"file://{tmp_path}").count() == 0
    twice = spark.createDataFrame([("a", "x", "F32", [1], [1.0])] * 2, "file string, name string, dtype string, shape array<long>, data array<double>")
    with pytest.raises(Exception, match="two tensors of one name"):
        T.write(twice, f"file://{tmp_path}", "safetensors")


def test_halves_of_floats_are_rounded_to_even():
    x = np.array([1.0, 1 + 2**-8, 1 + 3 * 2**-8, -2.5, 1e-3, 65280.0])
    got = T.values("BF16", T.stored("BF16", x))
    assert got[:4].tolist() == [1.0, 1.0, 1 + 2**-6, -2.5] and np.abs(got[4:] / x[4:] - 1).max() < 2**-8
