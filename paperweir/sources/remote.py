"""Files of any file system that Arrow opens, and code that goes with what uses it."""

from __future__ import annotations

import hashlib
import sys

from pyarrow import fs
from pyspark import cloudpickle


def system_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, by its address, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def there(system: fs.FileSystem, folder: str, recursive: bool = False) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, recursive=recursive, allow_not_found=True))


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def mark(inner: str) -> str:
    """The name under which a file, by its path in the inbox, is kept as blocked."""
    return hashlib.sha256(inner.encode()).hexdigest()


def by_value(*modules: str) -> None:
    """Spark plans sources, sinks and states in processes of the driver that have no package but what they are sent."""
    for name in (__name__, *modules):
        cloudpickle.register_pickle_by_value(sys.modules[name])
