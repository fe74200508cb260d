"""Files by path or URI for Python data sources: any store that pyarrow opens; a bare path is a local or mounted one."""

from __future__ import annotations

import fnmatch
import posixpath
from typing import BinaryIO

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a file's, a folder's or a pattern's path means, in order of names.

    Names that start with a dot or an underscore are not data.
    """
    store, inner = located(path)
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    wild = any(c in inner for c in "*?[")
    info = store.get_file_info(inner) if not wild else None
    if info is not None and info.type == fs.FileType.File:
        found = [info]
    else:
        root = inner
        while any(c in root for c in "*?["):
            root = posixpath.dirname(root)
        inside = store.get_file_info(fs.FileSelector(root, recursive=wild, allow_not_found=wild))
        found = [f for f in inside if f.type == fs.FileType.File and (not wild or fnmatch.fnmatch(f.path, inner))]
    return sorted((scheme + f.path, f.size) for f in found if not posixpath.basename(f.path).startswith((".", "_")))


def opened(path: str) -> BinaryIO:
    """A stream of a file's bytes, from its start."""
    store, inner = located(path)
    return store.open_input_stream(inner, compression=None)


def opened_anywhere(path: str) -> BinaryIO:
    """A file that can seek."""
    store, inner = located(path)
    return store.open_input_file(inner)
