"""Byte access to files under a URI from Python, on the driver or in tasks: local and mounted folders, else what pyarrow can reach."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return unquote(u.path) if u.scheme else uri
    return None


def put(uri: str, data: bytes) -> None:
    """Writes a file whole: under a name of its own first, so that a repeated or lost task leaves no torn file."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        path = _local(uri)
        if path is not None:
            self.file, self.size = open(path, "rb"), os.path.getsize(path)  # noqa: SIM115
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            self.file, self.size = system.open_input_file(path), system.get_file_info(path).size

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"file ends at {offset + len(out)}, {offset + length} expected")
        return bytes(out)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
