"""Files behind a path or URI, through the file systems that Arrow knows."""

from __future__ import annotations


def filesystem(path: str):
    """(file system, plain path) of a path or URI; file:, hdfs:, s3: and gs: URIs are known."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = f"file://{path[5:]}"
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def data_files(path: str) -> list[str]:
    """The Parquet files at path, a file or a folder, in the order of their names; hidden ones are left out."""
    from pyarrow import fs

    system, plain = filesystem(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(plain, recursive=True))
    names = (x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".parquet"))
    return [f"{scheme}{n}" for n in sorted(names) if not any(p.startswith(("_", ".")) for p in n[len(plain) :].split("/"))]
