"""Files that Python workers write to and read from the shared folder, whatever its scheme."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def mounted(uri: str) -> str | None:
    """The local path of a shared folder that is mounted, made if need be; None for one in an object store."""
    store, path = open_fs(uri)
    if not isinstance(store, fs.LocalFileSystem):
        return None
    store.create_dir(path, recursive=True)
    return path


def exists(uri: str) -> bool:
    store, path = open_fs(uri)
    return store.get_file_info(path).type == fs.FileType.File


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """The arrays one after another; each begins at a multiple of 64 bytes after its own header.

    The file gets its name when it is whole, so that a task which is run again, or twice at once, does no harm.
    """
    store, path = open_fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    whole, path = path, f"{path}.{uuid.uuid4().hex[:12]}"
    with store.open_output_stream(path) as out:
        for a in arrays:
            out.write(np.array([len(a), ord(a.dtype.kind), a.dtype.itemsize, 0, 0, 0, 0, 0], "<i8").tobytes())
            body = np.ascontiguousarray(a).view(np.uint8)
            out.write(body)
            out.write(b"\0" * (-len(body) % 64))
    store.move(path, whole)


def map_arrays(uri: str) -> list[np.ndarray]:
    """The arrays of a file: memory-mapped where the folder is mounted, else read from the store."""
    store, path = open_fs(uri)
    buf = pa.memory_map(path).read_buffer() if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path).read_buffer()
    out, at = [], 0
    while at < buf.size:
        n, kind, width = np.frombuffer(buf, "<i8", 3, at)
        out.append(np.frombuffer(buf, np.dtype(f"<{chr(kind)}{width}"), n, at + 64))
        at += 64 + int(n * width) + int(-(n * width) % 64)
    return out
