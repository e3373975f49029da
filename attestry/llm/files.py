"""Files that tasks read and write themselves, in any store that pyarrow.fs opens (local, HDFS, S3, ...)."""

from __future__ import annotations

import re
import uuid


def opened(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    if not re.match(r"[a-z0-9]+:", folder):
        folder = "file://" + folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class Committed:
    """An output file that bears its name only once it is whole: written under a temporary name, then moved.

    A task that is run again writes the same bytes and moves them over the same name.
    """

    def __init__(self, store, folder: str, name: str):
        self.store, self.final, self.temporary = store, f"{folder}/{name}", f"{folder}/_temporary/{uuid.uuid4().hex}-{name}"
        store.create_dir(f"{folder}/_temporary", recursive=True)
        self.stream = store.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.store.move(self.temporary, self.final)
