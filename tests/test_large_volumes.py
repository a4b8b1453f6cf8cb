"""Volumes decoded in pieces give what decoding them whole gives, in little memory."""

import gzip
import itertools
import tracemalloc

import numpy as np
import pytest

from kindred.functions import nifti
from kindred.operators import files


def affines():
    r = np.random.RandomState(1)
    for order, signs in itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3)):
        m = np.zeros((4, 4))
        m[order, range(3)] = np.array(signs) * (1, 2, 3)
        m[:3, 3] = r.normal(0, 9, 3)
        m[3, 3] = 1
        yield m


def test_every_orientation(tmp_path):
    r, path = np.random.RandomState(2), str(tmp_path / "v.nii")
    for affine in affines():
        data = nifti.build(r.randint(-9, 9, (4, 5, 6)).astype(np.int16), affine)
        open(path, "wb").write(data)
        for held in (1, 400, 1 << 20):
            assert nifti.inspect_file(path, held) == nifti.inspect(data)


@pytest.mark.parametrize("shape", [(7,), (4, 3), (2, 3, 4, 1), (3, 4, 2, 5), (2, 3, 2, 3, 2), (0, 3, 2), (2, 2, 2, 0)])
def test_shapes_types_and_scaling(tmp_path, shape):
    r, turned = np.random.RandomState(3), list(affines())[29]
    for dtype, (slope, inter), affine, zipped in itertools.product(("u1", "i2", "f4", "f8", "i8"), ((0.0, 0.0), (2.5, -1.0)), (None, turned), (False, True)):
        x = (r.normal(0, 1, shape) * (2**60 if dtype == "i8" else 50)).astype(dtype)
        if dtype == "f4" and x.size:
            x.ravel()[0] = np.nan
            x.ravel()[-1] = -0.0
        data = nifti.build(x, affine, slope=slope, inter=inter, extensions=((6, b"note"),))
        path = str(tmp_path / "v.nii")
        open(path, "wb").write(gzip.compress(data) if zipped else data)
        want = nifti.inspect(data)
        for held in (1, 100, 1 << 20):
            got = nifti.inspect_file(path, held)
            assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_faulty_files(tmp_path):
    data, path = nifti.build(np.zeros((3, 4, 5), np.int16)), str(tmp_path / "v.nii")
    for bad in (data[:-1], data[:200], b"", data[:344] + b"xx" + data[346:], gzip.compress(data)[:-30]):
        open(path, "wb").write(bad)
        with pytest.raises((ValueError, EOFError)):
            nifti.inspect_file(path)


def test_memory_and_facts_of_a_large_file(tmp_path, monkeypatch):
    x = np.random.RandomState(4).randint(0, 255, (256, 256, 400)).astype(np.float32)  # 105 MB
    data = nifti.build(x, list(affines())[7])
    path = tmp_path / "v.nii"
    path.write_bytes(data)
    want = nifti.inspect(data)
    want["raw_hash"] = __import__("hashlib").sha256(data).hexdigest()
    del x, data
    monkeypatch.setattr(files, "LARGE_BYTES", 1 << 20)
    monkeypatch.setattr(nifti.inspect_file, "__defaults__", (16 << 20,))
    tracemalloc.start()
    got = files.read_facts(str(path), nifti.inspect)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k: got[k] for k in want} == want and peak < 64 << 20
