"""Binary access to files that a path or a URI names."""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from typing import BinaryIO


class FormatError(ValueError):
    """A file that is not what its format asks for."""


class SasError(FormatError):
    pass


class StataError(FormatError):
    pass


class SpssError(FormatError):
    pass


def split_uri(path: str):
    """A pyarrow file system and a path in it, or None and a local path."""
    path = str(path)
    if path.startswith("file:"):
        return None, re.sub(r"^file:/*", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)
    return None, path


def open_binary(path: str) -> BinaryIO:
    store, at = split_uri(path)
    return store.open_input_file(at) if store else open(at, "rb")


def file_size(path: str) -> int:
    with open_binary(path) as f:
        return f.seek(0, 2)


def listed(pattern: str) -> list[str]:
    """Files of one folder whose names match a pattern, in the order of their names."""
    folder, _, name = pattern.rpartition("/")
    store, at = split_uri(folder or ".")
    if store is None:
        return sorted(glob.glob(os.path.join(at, name)))
    from pyarrow import fs

    root = pattern[: len(pattern) - len(name) - 1]
    return sorted(f"{root}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(at)) if fnmatch.fnmatch(f.base_name, name))
