"""NIfTI-1 single files (plain or gzipped): header facts, canonical voxels and their hashes.

Written from the published format: a header of 348 bytes in either byte order, extensions,
then voxels in Fortran order from vox_offset on.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np

# Codes of the voxel types.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_BYTES = 348
AXES = (("L", "R"), ("P", "A"), ("I", "S"))


@dataclass(frozen=True)
class Image:
    """header: its 348 bytes; extensions: (code, size) of each; voxels: as stored, without scaling."""

    header: bytes
    extensions: tuple[tuple[int, int], ...]
    voxels: np.ndarray
    zooms: tuple[float, ...]
    slope: float | None
    inter: float | None
    qform_code: int
    sform_code: int
    qform: np.ndarray | None
    sform: np.ndarray | None

    @property
    def affine(self) -> np.ndarray:
        """sform if it is set, else qform, else the zooms around the centre with x to the left."""
        if self.sform is not None:
            return self.sform
        if self.qform is not None:
            return self.qform
        zooms = np.array([*self.zooms[:3], 1.0, 1.0, 1.0][:3]) * (-1, 1, 1)
        shape = np.array([*self.voxels.shape[:3], 1, 1, 1][:3])
        out = np.diag([*zooms, 1.0])
        out[:3, 3] = -zooms * (shape - 1) / 2
        return out

    def values(self) -> np.ndarray:
        """Voxels with slope and intercept applied; stored type where there are none."""
        if self.slope is None:
            return self.voxels
        return self.voxels.astype(np.float64) * self.slope + self.inter


def _rotation(b: float, c: float, d: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    return np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )


def described(data: bytes) -> tuple[Image, int]:
    """An image without its voxels (an array of their shape and type that takes no memory), and their offset.

    data: the file from its begin at least to where the voxels begin. ValueError on what is no NIfTI-1 single file.
    """
    if len(data) < HEADER_BYTES:
        raise ValueError("shorter than a header")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data, 0)[0] == HEADER_BYTES), None)
    if order is None or data[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 single file")
    dim = struct.unpack_from(order + "8h", data, 40)
    if not 1 <= dim[0] <= 7 or min(dim[1 : dim[0] + 1]) < 0:
        raise ValueError(f"dimensions {dim}")
    shape = dim[1 : dim[0] + 1]
    code = struct.unpack_from(order + "h", data, 70)[0]
    if code not in DTYPES:
        raise ValueError(f"voxel type {code}")
    pixdim = struct.unpack_from(order + "8f", data, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", data, 108)
    qcode, scode = struct.unpack_from(order + "2h", data, 252)
    b, c, d, *shift = struct.unpack_from(order + "6f", data, 256)
    rows = np.array(struct.unpack_from(order + "12f", data, 280), np.float64).reshape(3, 4)
    sform = np.vstack([rows, [0, 0, 0, 1]]) if scode > 0 else None
    qform = None
    if qcode > 0:
        qform = np.eye(4)
        qform[:3, :3] = _rotation(b, c, d) * (pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1))
        qform[:3, 3] = shift
    extensions, at = [], HEADER_BYTES + 4
    if len(data) >= at and data[HEADER_BYTES] != 0:
        while at + 8 <= min(int(offset), len(data)):
            size, kind = struct.unpack_from(order + "2i", data, at)
            if size < 8:
                break
            extensions.append((kind, size))
            at += size
    dtype = np.dtype(order + DTYPES[code])
    voxels = np.broadcast_to(np.zeros((), dtype), shape)
    scaled = np.isfinite(slope) and slope != 0 and np.isfinite(inter) and (slope, inter) != (1.0, 0.0)
    return Image(data[:HEADER_BYTES], tuple(extensions), voxels, tuple(map(float, pixdim[1 : len(shape) + 1])), slope if scaled else None, inter if scaled else None, qcode, scode, qform, sform), int(offset)


def parse(data: bytes) -> Image:
    """ValueError on what is no complete NIfTI-1 single file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    image, offset = described(data)
    count = int(np.prod(image.voxels.shape, dtype=np.int64))
    if len(data) < offset + count * image.voxels.dtype.itemsize:
        raise ValueError("voxels are missing")
    return replace(image, voxels=np.frombuffer(data, image.voxels.dtype, count, offset).reshape(image.voxels.shape, order="F"))


def orientation(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each of the first three voxel axes the world axis it is nearest to, and its direction (1 or -1).

    Zooms are taken out and the rotation nearest to what is left decides; the strongest match
    of an axis still free is taken in the order of the voxel axes.
    """
    m = affine[:3, :3].astype(float)
    length = np.sqrt((m * m).sum(0))
    length[length == 0] = 1
    u, s, vt = np.linalg.svd(m / length, full_matrices=False)
    keep = s > s.max() * 3 * np.finfo(float).eps
    near = u[:, keep] @ vt[keep]
    out, free = [], np.ones(3, bool)
    for axis in range(3):
        strength = np.where(free, np.abs(near[:, axis]), -1)
        to = int(strength.argmax())
        free[to] = False
        out.append((to, -1 if near[to, axis] < 0 else 1))
    return out


def axis_codes(affine: np.ndarray) -> str:
    return "".join(AXES[to][sign > 0] for to, sign in orientation(affine))


def canonical(values: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Voxels with their first three axes turned to right, anterior, superior, and the affine that fits."""
    while values.ndim < 3:
        values = values[..., None]
    turn, turned = orientation(affine), affine.astype(float).copy()
    for axis, (_, sign) in enumerate(turn):
        if sign < 0:
            values = np.flip(values, axis)
            turned[:3, 3] += turned[:3, axis] * (values.shape[axis] - 1)
            turned[:3, axis] *= -1
    order = [next(a for a, (to, _) in enumerate(turn) if to == world) for world in range(3)]
    return values.transpose(*order, *range(3, values.ndim)), turned[:, [*order, 3]]


def voxel_bytes(values: np.ndarray) -> bytes:
    """Little-endian float32 in C order, a volume of a 4-D image after the other. Shape and affine don't count."""
    volumes = [values[..., t] for t in range(values.shape[3])] if values.ndim == 4 else [values]
    return b"".join(np.ascontiguousarray(v, "<f4").tobytes() for v in volumes)


def value_hash(values: np.ndarray) -> str:
    """Equal for arrays of equal values and shape, whatever their type; one volume of a 4-D image
    counts as a 3-D one, NaN equals NaN."""
    if values.ndim == 4 and values.shape[3] == 1:
        values = values[..., 0]
    plain = np.ascontiguousarray(values, "<f8") + 0.0
    plain[np.isnan(plain)] = np.nan
    return hashlib.sha256(repr(values.shape).encode() + plain.tobytes()).hexdigest()


def _flat(m: np.ndarray | None) -> list[float] | None:
    return None if m is None else [float(x) for x in m.ravel()]


def _facts(image: Image, values: np.ndarray, affine: np.ndarray) -> dict:
    """Header facts; values: of the canonical shape and type, whatever they hold."""
    return {
        "shape": [int(n) for n in values.shape], "dtype": values.dtype.newbyteorder("=").name,
        "zooms": [round(z, 6) if np.isfinite(z) else z for z in image.zooms], "axcodes_original": axis_codes(image.affine), "axcodes_canonical": axis_codes(affine), "slope": image.slope, "inter": image.inter,
        "qform_code": image.qform_code, "sform_code": image.sform_code, "qform": _flat(image.qform), "sform": _flat(image.sform),
        "header_hash": hashlib.sha256(image.header).hexdigest(), "extensions": ",".join(f"{c}:{n}" for c, n in image.extensions),
    }


def inspect(data: bytes) -> dict:
    """What verification compares, of the bytes of a file: can_hash, value_hash and header facts."""
    image = parse(data)
    values, affine = canonical(image.values(), image.affine)
    return {"can_hash": hashlib.sha256(voxel_bytes(values)).hexdigest(), "value_hash": value_hash(values)} | _facts(image, values, affine)


#: Bytes of voxels that `inspect_file` holds, about, and of a header with its extensions, at most.
HELD_BYTES, MOST_HEAD = 64 << 20, 16 << 20


def _opened(path: str) -> BinaryIO:
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
    return gzip.open(path) if zipped else open(path, "rb")


class _Pieces:
    """Reads a file's voxels plane by plane, as often as its canonical order needs.

    The order of canonical voxels begins with an axis that is seldom the file's slowest one; so
    each pass over the file gathers a few planes of that first axis.
    """

    def __init__(self, path: str, image: Image, offset: int):
        self.path, self.image, self.offset = path, image, offset
        self.stored = image.voxels.shape + (1,) * (3 - image.voxels.ndim)
        turn = orientation(image.affine)
        self.flipped = [sign < 0 for _, sign in turn]
        self.order = [next(a for a, (to, _) in enumerate(turn) if to == world) for world in range(3)]
        self.dtype = image.voxels.dtype if image.slope is None else np.dtype(np.float64)
        self.rest = self.stored[3:]

    def planes(self) -> Iterator[tuple[int, tuple[int, ...], np.ndarray]]:
        """Third index, further indices and values of each plane, in the file's order."""
        size = self.stored[0] * self.stored[1] * self.image.voxels.dtype.itemsize
        with _opened(self.path) as f:
            f.seek(self.offset)
            for further in np.ndindex(*self.rest[::-1]):
                for z in range(self.stored[2]):
                    raw = f.read(size)
                    if len(raw) < size:
                        raise ValueError("voxels are missing")
                    plane = np.frombuffer(raw, self.image.voxels.dtype).reshape(self.stored[:2], order="F")
                    yield z, further[::-1], plane if self.image.slope is None else plane.astype(np.float64) * self.image.slope + self.image.inter

    def _empty(self, n: int, rest: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """n canonical planes, and the same memory with the axes of the file."""
        out = np.empty((n, *(self.stored[a] for a in self.order[1:]), *rest), self.dtype)
        view = out.transpose(*np.argsort(self.order), *range(3, out.ndim))
        for axis, flip in enumerate(self.flipped):
            view = np.flip(view, axis) if flip else view
        return out, view

    def _put(self, view: np.ndarray, lo: int, hi: int, z: int, rest: tuple[int, ...], plane: np.ndarray) -> None:
        first = self.order[0]
        n = self.stored[first]
        at = slice(n - hi, n - lo) if self.flipped[first] else slice(lo, hi)
        if first == 2:
            if at.start <= z < at.stop:
                view[(slice(None), slice(None), z - at.start, *rest)] = plane
        else:
            view[(slice(None), slice(None), z, *rest)] = plane[at] if first == 0 else plane[:, at]

    def blocks(self, held: int, rest: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """Ranges of the first canonical axis of about `held` bytes."""
        n = self.stored[self.order[0]]
        one = max(1, int(np.prod([self.stored[a] for a in self.order[1:]], dtype=np.int64)) * int(np.prod(rest, dtype=np.int64)) * 8)
        step = max(1, held // one)
        yield from ((lo, min(lo + step, n)) for lo in range(0, n, step))

    def whole(self, held: int) -> Iterator[np.ndarray]:
        """The canonical voxels in C order, in pieces."""
        for lo, hi in self.blocks(held, self.rest):
            out, view = self._empty(hi - lo, self.rest)
            for z, rest, plane in self.planes():
                self._put(view, lo, hi, z, rest, plane)
            yield out

    def volumes(self, held: int) -> Iterator[np.ndarray]:
        """The same of each volume of a 4-D image, one after the other; small volumes in one pass over the file."""
        ranges = list(self.blocks(held, ()))
        for lo, hi in ranges if len(ranges) == 1 else []:
            out, view = self._empty(hi - lo, ())
            for z, _, plane in self.planes():
                self._put(view, lo, hi, z, (), plane)
                if z == self.stored[2] - 1:
                    yield out
        for t in range(self.rest[0]) if len(ranges) > 1 else ():
            for lo, hi in ranges:
                out, view = self._empty(hi - lo, ())
                for z, (own,), plane in self.planes():
                    if own > t:
                        break
                    if own == t:
                        self._put(view, lo, hi, z, (), plane)
                yield out


def inspect_file(path: str, held: int = HELD_BYTES) -> dict:
    """What `inspect` gives, of a file of any size: about 2 * held bytes of its voxels are in memory at a time.

    A file is read once for each held bytes of its values (as 8 bytes each) and hash.
    """
    with _opened(path) as f:
        head = f.read(HEADER_BYTES + 4)
        begin = described(head)[1]
        if begin > MOST_HEAD:
            raise ValueError(f"voxels begin at {begin}")
        head += f.read(max(0, begin - len(head)))
    image, offset = described(head)
    pieces = _Pieces(path, image, offset)
    like, affine = canonical(np.broadcast_to(np.zeros((), pieces.dtype), image.voxels.shape), image.affine)
    can, value = hashlib.sha256(), hashlib.sha256(repr(like.shape[:3] if like.ndim == 4 and like.shape[3] == 1 else like.shape).encode())
    empty = not np.prod(like.shape)
    for part in () if empty else pieces.volumes(held) if like.ndim == 4 else pieces.whole(held):
        can.update(np.ascontiguousarray(part, "<f4").tobytes())
    for part in () if empty else pieces.whole(held):
        plain = np.ascontiguousarray(part, "<f8") + 0.0
        plain[np.isnan(plain)] = np.nan
        value.update(plain.tobytes())
    return {"can_hash": can.hexdigest(), "value_hash": value.hexdigest()} | _facts(image, like, affine)


#: How files too large for memory are inspected (see operators.files).
inspect.in_pieces = inspect_file


def build(values: np.ndarray, affine: np.ndarray | None = None, zooms: tuple[float, ...] | None = None, slope: float = 0.0, inter: float = 0.0, description: bytes = b"", extensions: tuple[tuple[int, bytes], ...] = ()) -> bytes:
    """The bytes of a small NIfTI-1 file; the affine becomes the sform."""
    kind = next(c for c, name in DTYPES.items() if np.dtype(name) == values.dtype.newbyteorder("="))
    extra = b"".join(struct.pack("<2i", -(-(len(d) + 8) // 16) * 16, c) + d.ljust(-(-(len(d) + 8) // 16) * 16 - 8, b"\0") for c, d in extensions)
    head = bytearray(HEADER_BYTES)
    struct.pack_into("<i", head, 0, HEADER_BYTES)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, kind, values.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *((zooms or (1.0,) * values.ndim) + (1.0,) * 7)[:7])
    struct.pack_into("<3f", head, 108, float(HEADER_BYTES + 4 + len(extra)), slope, inter)
    head[148 : 148 + len(description[:80])] = description[:80]
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + bytes([bool(extra), 0, 0, 0]) + extra + values.astype(values.dtype.newbyteorder("<")).tobytes(order="F")
