"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

from pyarrow import fs


def at(url: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of a URL such as file:///a, hdfs://host/a or s3://bucket/a."""
    if "://" not in url:
        url = url.replace("file:", "file://", 1) if url.startswith("file:") else f"file://{url}"
    return fs.FileSystem.from_uri(url)


def write(url: str, data: bytes) -> None:
    store, path = at(url)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def read(url: str) -> bytes:
    store, path = at(url)
    with store.open_input_stream(path, compression=None) as file:
        return file.read()


def make_folder(url: str) -> None:
    store, path = at(url)
    store.create_dir(path, recursive=True)
