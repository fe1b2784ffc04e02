"""Byte ranges of files, read where they are needed."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow.fs as pafs

PAGE = 1 << 16
PAGES = 64


def local_path(path: str) -> str | None:
    """The path on a mounted file system; None for other stores."""
    if path.startswith("file:"):
        rest = path[5:]
        return "/" + rest.lstrip("/")
    return None if "://" in path else path


class Ranged:
    """A file as a sequence of bytes: ``data[a:b]`` reads that range and no more than a page around it.

    Local and mounted paths, and any store that Arrow opens: HDFS and viewfs (by libhdfs), S3, GCS.
    """

    def __init__(self, path: str):
        local = local_path(path)
        store, name = (pafs.LocalFileSystem(), local) if local else pafs.FileSystem.from_uri(path)
        self._file = store.open_input_file(name)
        self._size = self._file.size()
        self._pages: OrderedDict[int, bytes] = OrderedDict()
        self.reads = self.bytes_read = 0

    def __len__(self) -> int:
        return self._size

    def _read(self, at: int, size: int) -> bytes:
        data = self._file.read_at(size, at)
        self.reads += 1
        self.bytes_read += len(data)
        return data

    def _page(self, k: int) -> bytes:
        if k in self._pages:
            self._pages.move_to_end(k)
        else:
            self._pages[k] = self._read(k * PAGE, min(PAGE, self._size - k * PAGE))
            if len(self._pages) > PAGES:
                self._pages.popitem(last=False)
        return self._pages[k]

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self._size)
        if stop <= start:
            return b""
        if stop - start > PAGE:
            return self._read(start, stop - start)
        first, last = start // PAGE, (stop - 1) // PAGE
        data = b"".join(self._page(k) for k in range(first, last + 1))
        return data[start - first * PAGE : stop - first * PAGE]

    def close(self) -> None:
        self._file.close()
