"""Files that tasks open themselves, in any store that pyarrow knows (local, HDFS, S3, GCS, Azure): by URI, as Spark names them."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path
from typing import BinaryIO

from pyarrow import fs

CHUNK = 1 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[A-Za-z][\w+.\-]*:", uri):
        uri = Path(uri).absolute().as_uri()
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def opened(uri: str):
    """The file for reading; it can be read from any place on."""
    system, path = located(uri)
    return system.open_input_file(path)


def exists(uri: str) -> bool:
    system, path = located(uri)
    return system.get_file_info(path).type == fs.FileType.File


def head(uri: str, size: int) -> bytes:
    with opened(uri) as f:
        return f.read(size)


def put(uri: str, source: BinaryIO) -> int:
    """Writes a file under another name and moves it to its own when it is complete; its size."""
    system, path = located(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}.draft", 0
    try:
        with system.open_output_stream(draft) as out:
            while part := source.read(CHUNK):
                out.write(part)
                size += len(part)
        system.move(draft, path)
    except BaseException:
        if system.get_file_info(draft).type == fs.FileType.File:
            system.delete_file(draft)
        raise
    return size
