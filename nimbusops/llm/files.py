"""Files in the shared folder, written and range-read by tasks through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI; the folder is made if need be."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path
