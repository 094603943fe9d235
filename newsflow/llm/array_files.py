"""Files of named arrays in the shared folder, written by tasks and memory-mapped
by others."""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs

ALIGN = 64


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under a name of its own, then rename: a task that is run twice, or
    lost half way, leaves a whole file."""
    system, path = _opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        at = -(-at // ALIGN) * ALIGN
        head[name] = [a.dtype.str, len(a), at]
        at += a.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    new = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        done = 0
        for (_, _, start), a in zip(head.values(), arrays.values(), strict=True):
            out.write(b"\0" * (start - done))
            out.write(np.ascontiguousarray(a).tobytes())
            done = start + a.nbytes
    system.move(new, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-map a file.  One in a store that cannot be mapped is copied to the
    task's own temporary folder first and unlinked at once."""
    system, path = _opened(uri)
    if isinstance(system, pafs.LocalFileSystem):
        file = open(path, "rb")  # noqa: SIM115
    else:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        with system.open_input_stream(path) as source:
            while chunk := source.read(1 << 22):
                file.write(chunk)
        file.flush()
    with file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    base = 8 + size
    return {
        name: np.frombuffer(data, dtype, count=n, offset=base + start) if n else np.zeros(0, dtype)
        for name, (dtype, n, start) in json.loads(data[8:base]).items()
    }
