"""Flat files in the shared folder."""

import numpy as np
from pyarrow import fs

from propspark.llm import store


def test_qualified(spark):
    assert store.qualified(spark, "/tmp/x").startswith("file:") and store.resolve(store.qualified(spark, "/tmp/x"))[1] == "/tmp/x"
    assert store.qualified(spark, "file:///tmp/x y").endswith("/tmp/x y")


def test_ranges_read_what_a_map_shows(tmp_path):
    numbers = np.arange(1000, dtype="<u4")
    numbers.tofile(tmp_path / "a.bin")
    np.testing.assert_array_equal(store.mapped(str(tmp_path / "a.bin"), "<u4"), numbers)
    read = store.Ranges(fs.LocalFileSystem().open_input_file(str(tmp_path / "a.bin")), "<u4")
    assert len(read) == 1000
    for at in (slice(0, 10), slice(990, 2000), slice(5, 5), slice(None)):
        np.testing.assert_array_equal(read[at], numbers[at])
