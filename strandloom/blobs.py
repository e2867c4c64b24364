"""Append-only files in the shared folder, read back by ranges; any store that pyarrow reaches.

Spark's names of object stores (s3a, s3n, abfss) are pyarrow's s3 and abfs. hdfs needs libhdfs on every
worker; a scheme that pyarrow does not know, viewfs for one, is refused by name.

Each writer has a file name that no other attempt uses, and readers go by committed rows
only, so what a lost or repeated task has written is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}  # Hadoop's name: pyarrow's


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop URI and the path in it."""
    scheme, colon, rest = uri.partition("://")
    if colon:
        uri = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    try:
        return fs.FileSystem.from_uri(uri)
    except (OSError, ValueError) as e:
        raise OSError(f"files beside tables need a store that pyarrow reaches; {uri} is none here: {e}") from e


class Writer:
    def __init__(self, root: str, name: str):
        self.name = f"{name}-{uuid.uuid4().hex[:12]}"
        store, path = store_of(f"{root}/{self.name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.at = 0

    def append(self, data: bytes) -> int:
        """Where the data begin."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Reader:
    """Range reads; the last few files stay open."""

    def __init__(self, root: str, keep: int = 64):
        self.root, self.keep, self.files = root, keep, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.files.get(name)
        if file is None:
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            store, path = store_of(f"{self.root}/{name}")
            file = self.files[name] = store.open_input_file(path)
        data = file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{name} ends before {offset + length}")
        return data
