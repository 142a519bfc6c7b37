"""Plain binary files in the folder that all machines share."""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark itself would resolve it: all machines then mean the same one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def make_dir(path: str) -> None:
    store, at = resolve(path)
    store.create_dir(at, recursive=True)


def open_output(path: str) -> pa.NativeFile:
    store, at = resolve(path)
    return store.open_output_stream(at)


class Ranges:
    """The numbers of a flat file in a store that cannot map it: every slice is read when it is asked for."""

    def __init__(self, file: pa.NativeFile, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        first, last, _ = at.indices(len(self))
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, last - first) * width, first * width), self.dtype)


def mapped(path: str, dtype: str) -> np.ndarray | Ranges:
    """The numbers of a flat file: memory-mapped where the store is a file system, else read slice by slice."""
    store, at = resolve(path)
    if isinstance(store, fs.LocalFileSystem):
        size = store.get_file_info(at).size
        return np.memmap(at, dtype=dtype, mode="r") if size else np.empty(0, dtype)
    return Ranges(store.open_input_file(at), dtype)
