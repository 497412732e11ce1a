"""Single files opened where the code runs, on the driver or in a task: local paths and the URIs of shared storage."""

from __future__ import annotations

import io
import os
from typing import IO, TextIO


def _opened(path: str, write: bool = False) -> IO[bytes]:
    if path.startswith("file:") or "://" not in path:
        path = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        if write:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb" if write else "rb")
    from pyarrow import fs

    where, p = fs.FileSystem.from_uri(path)
    if write:
        where.create_dir(p.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(p) if write else where.open_input_stream(p)


def open_text(path: str) -> TextIO:
    return io.TextIOWrapper(_opened(path), encoding="utf-8")


def write_text(path: str, text: str) -> None:
    with _opened(path, write=True) as f:
        f.write(text.encode())


def first_letter(path: str) -> str:
    """The first character that is no white space; empty if there is none."""
    with open_text(path) as f:
        while c := f.read(1):
            if not c.isspace():
                return c
    return ""
