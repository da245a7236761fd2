"""Files in the shared folder, opened from Python tasks by URI."""

from __future__ import annotations

import re

from pyarrow import fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it. Folders are made; a local path is that of a shared mount."""
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + re.sub(r"^file:", "", uri).lstrip("/")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
