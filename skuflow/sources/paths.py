"""Files that Python code opens inside tasks, named as for Spark."""

from __future__ import annotations

from pyarrow import fs


def open_uri(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is one of this machine."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    if path.startswith("file://"):  # not as a URI: names may hold blanks and percent signs
        return fs.LocalFileSystem(), path.removeprefix("file://")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def data_files(path: str) -> list[fs.FileInfo]:
    """``path`` itself or all files below it, without those that writers hide (names with a leading ``_`` or ``.``)."""
    files, root = open_uri(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)]
    return sorted(shown, key=lambda f: f.path)
