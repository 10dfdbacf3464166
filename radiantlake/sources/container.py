"""Compressed array containers: a zstd container and npz, told apart by their first bytes."""

from __future__ import annotations

import io
import struct

import numpy as np

# Fixed values of the container's format, little-endian: its mark; then a count, and
# for each array name, type and compressed bytes (each with a 32 bit length before
# it), between them the number of dimensions (32 bit) and the dimensions (64 bit).
MARK = b"TSv4"
LARGEST = (1 << 32) - 1


def _counted(data: bytes) -> bytes:
    if len(data) > LARGEST:
        raise ValueError("an array of over 4 GiB compressed can't be stored")
    return struct.pack("<I", len(data)) + data


def dump(arrays: dict[str, np.ndarray], level: int = 19) -> bytes:
    """A container of named arrays; one zstd frame each."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    out = [MARK, struct.pack("<I", len(arrays))]
    for name, value in arrays.items():
        a = np.asarray(value)
        out += [_counted(name.encode()), _counted(a.dtype.str.encode()), struct.pack(f"<I{a.ndim}Q", a.ndim, *a.shape), _counted(press.compress(np.ascontiguousarray(a).tobytes()))]
    return b"".join(out)


def load(data: bytes) -> dict[str, np.ndarray]:
    """The inverse of dump; npz bytes are read as well."""
    if data[:4] != MARK:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return {k: z[k] for k in z.files}
    import zstandard

    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return out

    def counted() -> bytes:
        nonlocal at
        (n,) = take("I")
        at += n
        return data[at - n : at]

    arrays = {}
    for _ in range(take("I")[0]):
        name, kind = counted().decode(), np.dtype(counted().decode())
        shape = take(f"{take('I')[0]}Q")
        size = int(np.prod(shape)) * kind.itemsize
        arrays[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(counted(), max_output_size=max(size, 1)), dtype=kind).reshape(shape)
    return arrays


def dump_npz(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def kind_of(path: str) -> str:
    """tensor or npz, by the first four bytes."""
    with open(path, "rb") as f:
        return "tensor" if f.read(4) == MARK else "npz"
