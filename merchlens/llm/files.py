"""Files that Python tasks write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def write_file(path: str, parts: Iterable[bytes]) -> str:
    """Write a file under a name of this attempt's own and return it; a repeated task leaves no half file behind its name."""
    path = f"{path}-{uuid.uuid4().hex}"
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.part", "wb") as out:
            out.writelines(parts)
        os.replace(f"{local}.part", local)
    else:
        store, name = _at(path)
        with store.open_output_stream(name) as out:
            for part in parts:
                out.write(part)
    return path


def map_file(path: str) -> memoryview:
    """A file's bytes as mapped memory; from a remote store by way of an unnamed local copy."""
    if (local := _local(path)) is not None:
        with open(local, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if os.path.getsize(local) else memoryview(b"")
    store, name = _at(path)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(name) as f:
        while part := f.read(1 << 20):
            copy.write(part)
        copy.flush()
        return memoryview(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)) if copy.tell() else memoryview(b"")


def arrays_to_bytes(arrays: list[np.ndarray]) -> list[bytes]:
    """A header of (type, length) pairs and the arrays, each at a multiple of 8 bytes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    head = len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8)
    return [head, *(x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]


def arrays_from(data) -> list[np.ndarray]:
    """The arrays of ``arrays_to_bytes``, without a copy."""
    view = memoryview(data)
    size = int.from_bytes(view[:8], "little")
    at, out = 8 + size + (-size % 8), []
    for part in bytes(view[8:8 + size]).decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(view, np.dtype(kind), int(n), at))
        at += out[-1].nbytes + (-out[-1].nbytes % 8)
    return out
