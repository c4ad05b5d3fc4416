"""Binary files in the shared folder, read and written by tasks through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Whole:
    """A file that appears under its name only when it is complete, so a task that runs again or twice does no harm."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        folder, _, name = self.path.rpartition("/")
        self.system.create_dir(folder, recursive=True)
        self.partial = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.partial, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def finish(self) -> None:
        self.stream.close()
        self.system.move(self.partial, self.path)

    def abandon(self) -> None:
        self.stream.close()
        self.system.delete_file(self.partial)


def open_input(path: str):
    system, path = _open(path)
    return system.open_input_file(path)
