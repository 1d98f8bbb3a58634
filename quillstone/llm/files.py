"""Model files in the shared folder that workers map into memory.

A file holds several arrays behind a short header, so that one map serves them all, and a worker keeps a bounded number of maps:
those used longest ago are closed, and descriptors and mappings stay few however many ranges a model has.
"""

from __future__ import annotations

import json
import mmap
import os
import resource
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: Most maps of a worker; fewer where descriptors are scarce.
MOST_MAPS = 256
ALIGN = 64


def local_path(uri: str) -> str:
    """The mounted path of a shared folder. Memory-mapped files need one; other stores are refused here, before any work."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: spark.checkpoint.dir must be a mounted path (file:) for memory-mapped models")
    return unquote(parts.path)


def save_arrays(path: str, **arrays: np.ndarray) -> None:
    """Write arrays of one dimension as one file, under a name of its own first, so that a repeated task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // ALIGN) * ALIGN
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).data)
            f.write(bytes(-v.nbytes % ALIGN))
    os.replace(own, path)


def open_arrays(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped; None without the file. The map closes with the last array that is held."""
    try:
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    except FileNotFoundError:
        return None
    size = int.from_bytes(held[:8], "little")
    return {k: np.frombuffer(held, kind, n, 8 + size + at) for k, (kind, at, n) in json.loads(held[8 : 8 + size]).items()}


class Maps:
    """Files that are mapped as they are asked for; at most ``most`` at a time."""

    def __init__(self, most: int = MOST_MAPS):
        soft = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
        self.most = most if soft == resource.RLIM_INFINITY else max(1, min(most, soft // 4))
        self.held: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()

    def get(self, path: str) -> dict[str, np.ndarray] | None:
        if path in self.held:
            self.held.move_to_end(path)
            return self.held[path]
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[path] = made = open_arrays(path)
        return made
