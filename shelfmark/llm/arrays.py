"""Arrays in the folder that all executors share: written by one task each, memory-mapped by every worker.

A file is written under a name of its own and renamed when it is whole, so a
task that is lost or runs twice leaves one whole file. Where the shared folder
is a store that can't be mapped, a worker reads an array into memory instead.
"""

from __future__ import annotations

import io
import os
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import zstandard


def _local(folder: str) -> str | None:
    """The path of a folder that the file system shows, else null."""
    url = urlparse(folder)
    return unquote(url.path) if url.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    own = f"{name}.{uuid.uuid4().hex}"
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{own}", "wb") as f:
            np.save(f, array)
        os.replace(f"{path}/{own}", f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{own}") as f:
        out = io.BytesIO()
        np.save(out, array)
        f.write(out.getbuffer())
    store.move(f"{path}/{own}", f"{path}/{name}.npy")


@lru_cache(4096)
def load(folder: str, name: str) -> np.ndarray:
    path = _local(folder)
    if path is not None:
        at = f"{path}/{name}.npy"
        return np.load(at, mmap_mode="r" if os.path.getsize(at) > 4096 else None)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(io.BytesIO(f.readall()))


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as bytes. The first is in ascending order and kept as steps; bytes of equal weight stand together."""
    first, *rest = (np.ascontiguousarray(c, np.int64) for c in columns)
    each = [np.diff(first, prepend=0), *rest]
    return zstandard.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in each), 1)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, 8, -1)
    first, *rest = (np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw)
    return [np.cumsum(first), *rest]


def where(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key in sorted keys, and whether it is there. `wanted` in ascending order reads a map from front to back."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
